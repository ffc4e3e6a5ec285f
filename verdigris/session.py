"""Session factory: the settings that the operators' semantics lean on."""

from pyspark.sql import SparkSession


def get_session(app: str = "verdigris", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; anything in conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()
