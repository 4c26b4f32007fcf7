"""Session routing: rules, long sessions in blocks, and a stream that is stopped and goes on."""

from pyspark.sql import functions as F

from weftline.streaming import sessions as S

SAID = {
    "a": ["hello", "那款怎么样", "CCSS12345 延期了吗", "它呢", "继续", "INDOA123", "这款的面料", "完"],
    "b": ["它", "indoa999", "继续 CCSS99999", "该款延期", None, ""],
}
#: decision, intent, style and focus of each turn.
WANTED = {
    "a": [("direct_answer", "general_chat", None, None), ("route_v2", "unknown", None, None), ("route_v1", "style_delay", "CCSS12345", "延期"), ("route_v1", "style_timeline", "CCSS12345", None), ("continuation", "continuation", "CCSS12345", None), ("route_v1", "style_timeline", "INDOA123", None), ("route_v1", "style_timeline", "INDOA123", "面料"), ("route_v2", "unknown", None, None)],
    "b": [("route_v2", "unknown", None, None), ("route_v1", "style_timeline", "INDOA999", None), ("continuation", "continuation", "INDOA999", None), ("route_v1", "style_delay", "INDOA999", "延期"), ("route_v2", "unknown", None, None), ("route_v2", "unknown", None, None)],
}


def turns(spark, sessions=("a", "b")):
    return spark.createDataFrame([(s, i, t) for s in sessions for i, t in enumerate(SAID[s])], "session string, turn long, text string")


def told(df):
    return {(r.session, r.turn): (r.decision, r.intent, r.style_id, r.event_focus) for r in df.collect()}


def test_rules_and_blocks(spark):
    wanted = {(s, i): w for s, ws in WANTED.items() for i, w in enumerate(ws)}
    for block in (1, 3, S.BLOCK_TURNS):
        assert told(S.route_sessions(turns(spark), block=block)) == wanted
    alone = turns(spark).withColumn("session", F.when(F.col("session") == "b", "b"))
    assert told(S.route_sessions(alone, block=3)) == {(None if s == "a" else s, i): w for (s, i), w in wanted.items()}
    assert S.route_sessions(turns(spark).limit(0)).count() == 0
    model = S.decided(S.features(turns(spark), "session", "turn", "text").withColumn("before", F.lit("S")), F.when(F.col("turn") == 7, "general_chat"))
    assert told(model)[("a", 7)][0] == "direct_answer"


def test_a_stream_that_stops_goes_on(spark, tmp_path):
    df, path = turns(spark), str(tmp_path)

    def go():
        q = S.stream_sessions(spark, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path)
        q.awaitTermination()

    for n, (lo, hi) in enumerate(((0, 3), (3, 5), (5, 99))):
        df.where(F.col("turn").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        go()
        assert spark.read.parquet(f"{path}/out").count() == df.where(F.col("turn") < hi).count(), n
    assert told(spark.read.parquet(f"{path}/out")) == told(S.route_sessions(df))
