"""Operators that give back their input's rows keep columns of any name: every name that the operators give a helper, as an extra column."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from silt.llm import decontaminate, mixing, pieces, pii, quality, simhash

LLM = Path(pii.__file__).parent
OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def names():
    """Names in the code of the operators that stand where columns are named."""
    found = set()
    for path in [*LLM.glob("*.py"), Path(corpus_pipeline.__file__)]:
        code = path.read_text()
        found |= {n for text in re.findall(r'"([^"\n]*)"', code) for n in re.findall(r"[A-Za-z_]\w*", text) if len(text) < 120}
    return sorted(n for n in {f.lower() for f in found} if n not in OWN and len(n) < 24)


@pytest.fixture(scope="module")
def wide(spark):
    giant = "some words that differ " * 4000
    texts = [(0, "mail a@b.cd or call +1 (555) 010-9999"), (1, giant), (2, None), (3, ""), (4, "plain words " * 40), (5, "plain words " * 40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names()]).cache()


LABELS = [(0, 1), (4, 1), (5, 1)]  # nothing to tell apart: every document is accepted
TEXTS = ("text", "pieces_of_text", "text_again")
RUNS = {
    "redact": lambda s, d: pii.redact(d),
    "keep_good": lambda s, d: quality.keep_good(d, s.createDataFrame(LABELS, "doc_id long, quality int")),
    "dedupe": lambda s, d: simhash.dedupe(d),
    "drop_contaminated": lambda s, d: decontaminate.drop_contaminated(d, s.createDataFrame([(0, "no such words at all")], "item_id long, text string")),
    "mixed": lambda s, d: mixing.mixed(d),
    "encode": lambda s, d: pieces.encode(d, ids="pieces_of_text"),
    "decode": lambda s, d: pieces.decode(pieces.encode(d, ids="pieces_of_text"), ids="pieces_of_text", text="text_again"),
}


def test_names_are_many():
    assert {"base", "added", "left", "k", "found", "ids", "key", "g", "row"} <= set(names())


@pytest.mark.parametrize("name", RUNS)
def test_columns_stay(spark, wide, name):
    out = RUNS[name](spark, wide)
    assert [c for c in out.columns if c not in TEXTS] == [c for c in wide.columns if c not in TEXTS]
    kept = out.select("doc_id", *names()).collect()
    assert kept and all(r[n] == f"{n}:{r['doc_id']}" for r in kept for n in names())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, wide, name, tmp_path):
    for table, rows, schema in (("labels", LABELS, "doc_id long, quality int"), ("benchmark", [(0, "no such words at all")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, wide, str(tmp_path))
    own = [n for n in names() if n not in ("ids", "n_pieces")] if name == "sentencepiece" else names()
    kept = out.select("doc_id", *own).collect()
    assert kept and all(r[n] == f"{n}:{r['doc_id']}" for r in kept for n in own)
