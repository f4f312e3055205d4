"""What an action sends through exchanges on the local session."""


def written(spark, action):
    """(result of the action, bytes of shuffle files that it wrote)."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    out = action()
    return out, total() - before
