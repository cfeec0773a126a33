import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
CORE = [n for n in entry.oracle_sql() if n in ("site_filter_chain", "dosage_mode_impute", "ld_pairs", "fst_pairwise", "merge_full_outer", "fdr_bh", "window_gene_join", "p5_found", "p6_found", "p7_found")]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_knows_the_subpackage():
    for f in (ROOT / "loomspan").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not any(isinstance(n, (ast.ImportFrom, ast.Import)) and "llm" in ast.dump(n) for n in ast.walk(ast.parse(f.read_text()))), f


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6f}".replace("-0.000000", "0.000000")
    return repr(v)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(tuple(_norm(v) for v in r) for r in want)
