from pyspark.sql import functions as F

from weftline.operators.audit import append, verify


def state(log):
    return tuple(verify(log).first())


def test_chain_and_tampering(spark):
    first = append(spark, [{"at": "t1", "who": "a", "action": "read"}, {"at": "t2", "who": None, "action": "x", "payload": '{"k": 1}'}])
    last = first.orderBy(F.desc("seq")).first()
    log = spark.createDataFrame(first.union(append(spark, [{"at": "t3", "who": "b"}], last)).collect(), first.schema)
    assert [r["seq"] for r in log.orderBy("seq").collect()] == [1, 2, 3]
    assert state(log) == (True, 3, None)
    assert state(log.withColumn("payload", F.when(F.col("seq") == 2, "edited").otherwise(F.col("payload")))) == (False, 3, 2)
    assert state(log.where("seq <> 2")) == (False, 2, 3)
    assert state(log.withColumn("prev_hash", F.when(F.col("seq") == 3, "0").otherwise(F.col("prev_hash"))))[2] == 3
    assert state(log.where("seq = 9")) == (True, 0, None)
    assert append(spark, []).count() == 0
