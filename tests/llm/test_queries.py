import math

import pytest

from earshot.llm.queries import QUERIES
from earshot.llm.sql import SQL


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else x


def _table(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_cell, r)) for r in frame[columns].itertuples(index=False)), key=str)


FOUND = {
    "p1_found": "pred_id bigint, field string", "p2_found": "pred_id bigint, language string", "p4_found": "audio_id_a string, audio_id_b string", "p5_found": "table_name string, row_key string, field string",
    "p6_found": "speaker_id string", "p7_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint, sent_start int, sent_end int",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in FOUND:
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == FOUND[name]
        if name != "p7_ids":
            assert df.count() == df.distinct().count()
    if name in SQL:
        duckdb = pytest.importorskip("duckdb")
        from pathlib import Path

        con = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        assert _table(df.toPandas()) == _table(con.sql(SQL[name]).df())
    else:
        rows = df.count()
        assert rows > 0 and len(set(df.columns)) == len(df.columns)


def test_scratch_is_the_clusters(spark):
    from earshot.runtime import scratch_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark) == named.rstrip("/") if named else scratch_dir(spark).startswith("file://")
