import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions.scalar import normalize_item
from panelloom.streaming import streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The same rows in 1 and in 40 files; those are in no order of time."""
    rng = np.random.default_rng(1)
    rows = [(k, float(t), int(rng.integers(0, 12)) or None, str(rng.choice(["buy", "see"])), float(rng.integers(0, 99)) if k % 9 else None) for k, t in enumerate(rng.integers(0, 40 * 86_400, 1500))]
    df = spark.createDataFrame(rows, "event_id long, t double, user_id long, event_type string, value double")
    df = df.withColumn("ts", F.timestamp_seconds("t")).select("event_id", "ts", "user_id", "event_type", "value")
    top = tmp_path_factory.mktemp("streams")
    for n in (1, 40):
        df.repartition(n, F.xxhash64("event_id") if n > 1 else F.lit(0)).write.parquet(f"{top}/files{n}.parquet")
    return rows, str(top)


@pytest.mark.parametrize("files", [1, 40])
def test_asof_over_files_in_any_order(spark, source, files):
    rows, top = source
    s = streams.asof_previous(streams.file_stream(spark, f"{top}/files{files}.parquet", 4), "user_id", "event_type", "buy", 172_800.0)
    got = {r.event_id: (r.user_id, r.held) for r in streams.drain(s, "asof", latest="event_id").collect()}
    assert len(got) == len(rows)
    for i, t, u, _, _ in rows:
        own = [(x, j, v) for j, x, w, kind, v in rows if w == u and kind == "buy" and v is not None and x < t and t - x <= 172_800]
        assert got[i] == (u, max(own)[2] if own else None), i


def test_late_rows_are_answered_and_marked(spark, source):
    rows, top = source
    s = streams.asof_previous(streams.file_stream(spark, f"{top}/files40.parquet", 4), "user_id", "event_type", "buy", 172_800.0, lateness_s=86_400.0 * 60)
    assert {r.late for r in streams.drain(s, "late", latest="event_id").collect()} == {False}
    s = streams.asof_previous(streams.file_stream(spark, f"{top}/files40.parquet", 4), "user_id", "event_type", "buy", 172_800.0, lateness_s=86_400.0)
    got = streams.drain(s, "late", latest="event_id").collect()
    assert len(got) == len(rows) and sum(r.late for r in got) > 100  # no row is lost


def test_windows_and_sessions_over_many_files(spark, source):
    rows, top = source
    batch = spark.read.parquet(f"{top}/files1.parquet").where("user_id is not null")
    for make in (lambda d: streams.window_counts(d, ["event_type"], "6 hours"), lambda d: streams.window_counts(d, ["event_type"], "24 hours", "6 hours"), lambda d: streams.session_counts(d, ["user_id"], "8 hours")):
        s = streams.file_stream(spark, f"{top}/files40.parquet", 4).where("user_id is not null")
        got = sorted(map(repr, streams.drain(make(s), "many", "complete").collect()))
        assert got == sorted(map(repr, make(batch).collect()))


def test_items_of_all_characters(spark):
    """Against the decomposition itself, for every character that isn't a surrogate and some texts of several."""
    import re
    import unicodedata

    def want(s):
        s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "_", s).strip("_")

    chars = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(chars[k : k + 16]) for k in range(0, len(chars), 16)] + ["ệ", "a日b", "ét", "ﬁn", "x²", "Øst", "½ cup", "Ⅷ b", "𝐀𝟙 z", "", "plain text", "㎏/㎡"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").repartition(8)
    for r in df.select("x", normalize_item(F.col("x")).alias("y")).collect():
        assert r.y == want(r.x), repr(r.x)
    assert normalize_item(F.lit("7.0")) is not None and spark.range(1).select(normalize_item(F.lit("7.0"))).first()[0] == "7"
