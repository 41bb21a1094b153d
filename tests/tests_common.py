"""Helpers of several tests."""


def shuffled(df) -> int:
    """Records that the exchanges of a frame that was run have written."""

    def walk(p) -> int:
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().get("shuffleRecordsWritten")
        children = p.children()
        return (own.get().value() if own.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def written(spark, run) -> int:
    """Records that all stages of ``run()`` have written to shuffles."""
    sc = spark.sparkContext

    def stages() -> dict:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages().keys()
    run()
    return sum(n for k, n in stages().items() if k not in before)
