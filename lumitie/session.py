"""Spark session with the settings the phases are tuned for."""

from pyspark.sql import SparkSession


# Wide projections compile into methods the JIT refuses above 8000 bytes and then run
# many times slower; with this limit Spark uses its volcano path for those instead.
RUNTIME_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the phases rely on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, cores: int | None = None, app: str = "lumitie",
                  memory: str | None = None) -> SparkSession:
    """Adaptive execution with skew splitting; partition counts follow the cores locally."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if memory:
        b = b.config("spark.driver.memory", memory)
    if cores:
        b = b.config("spark.sql.shuffle.partitions", str(cores))
    spark = (b.config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.ui.enabled", "false").getOrCreate())
    return tune(spark)
