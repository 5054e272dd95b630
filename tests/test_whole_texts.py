"""Queries work on whole texts and all rows: held against plain Python, apart from their SQL."""

import re
import unicodedata

import pandas as pd

from linesmith import registry
from linesmith.sources.fixtures import Fixtures

from .conftest import SF

LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "ø": "o", "þ": "th", "ð": "d"})


def plain_accents(text):
    return re.sub(r"[^\x00-\x7f]", "", unicodedata.normalize("NFD", text.translate(LETTERS)))


def test_accents_are_removed_from_whole_texts(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = registry.QUERIES["p08_remove_accents"](spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got.plain)) == sorted(zip(docs.doc_id, docs.text.map(plain_accents)))
    assert (got.plain.str.len() > 250).any()


def test_training_rows_keep_whole_texts(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    got = registry.QUERIES["r02_r03_prepared"](spark, SF).toPandas()
    assert not got.text.duplicated().any() and (got.text.str.len() > 250).any()
    words = lambda t: re.findall("[a-z]+", t.lower())
    assert all(words(t)[-1:] == words(docs[u])[-1:] for u, t in zip(got.uid, got.text) if docs[u].isascii())


def test_names_are_looked_for_in_every_text(spark):
    t = Fixtures(spark, SF)
    texts = {r.description for r in t.invoice_lines.select("description").distinct().collect()}
    names = [r.unclean_name for r in t.manufacturers.collect()]
    got = registry.QUERIES["p19_p20_p21_names_in_text"](spark, SF).toPandas()
    assert sorted(zip(got.description, got.unclean_name)) == sorted((d, n) for d in texts for n in names if n in d)
    kinds = [r.description for r in t.invoice_lines.where("kind = 1").select("description").distinct().collect()]
    assert set(kinds) & set(got.description)
