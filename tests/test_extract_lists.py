"""Tokens of short texts, looked at in lists, tell the same as those of long ones, which are rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import ahead, extract
from sparkloom.plans import adapters

from .test_extract import SOURCES

HERE = "/root/testdata/sf0.001"
_SAID = [*"(){}[]=;<>,.:*/'\"`\n ", "=>", "import", "export", "default", "function", "class", "const", "let", "type", "enum", "Route", "path", "use", "useIt", "createContext", "from", "async", "as", "memo", "A", "Bé", "x1", "'s😀'", '"d"', '"./m"', "`t\n{`", "// c = (\n", "/* { \n */", "/[{]x/g", "</a>", "<b/>", "\r\n", " "]


def _soups(n: int) -> list[tuple[str, str, str]]:
    deal = random.Random(7)
    heads = ["export const A = (", "export { a, b as c } from ", "import type { T } from ", "<Route path=", "const B = memo(function (", "export default function (", "useIt(", "class K extends X {"]
    text = lambda: "".join(deal.choice(heads) if deal.random() < 0.15 else deal.choice(_SAID) + deal.choice(["", " ", " "]) for _ in range(deal.randrange(70)))
    return [(f"soup{i}", f"src/s{i}.tsx", text()) for i in range(n)]


def test_lists_tell_what_rows_tell(spark, monkeypatch):
    rows = _soups(1500) + [(k, f"src/{k}.tsx", t) for k, t in SOURCES.items()] + [("null", "n.ts", None), ("blank", "b.ts", " \n\t\n"), ("note", "c.ts", "// only")]
    files = spark.createDataFrame(rows, "file_id string, path string, text string").localCheckpoint()
    told = {r["file_id"]: r for r in extract.extract(files, expression_exports=True).collect()}
    monkeypatch.setattr(extract, "LONG", -1)
    assert {r["file_id"]: r for r in extract.extract(files, expression_exports=True).collect()} == told
    assert len(told) == len(rows) and sum(len(r[k]) for r in told.values() for k in extract.KINDS) > 5000


def test_slices_of_a_batch_tell_the_same(spark, monkeypatch):
    files = adapters.sources(spark, HERE).limit(40).select("file_id", extract._pieces(F.col("text")).alias("pieces"))
    needed = {n for k in extract.KINDS for n in extract._NEEDS[k]}
    batch = files.toArrow().combine_chunks().to_batches()[0]
    told = lambda: pa.Table.from_batches(ahead.runner(needed, ahead.columns(needed))(iter([batch])))
    whole = told()
    monkeypatch.setattr(ahead, "SLICE", 300)
    parts = told()
    assert parts.column("heads").num_chunks > 10 and parts.to_pylist() == whole.to_pylist() and len(parts) == 40
