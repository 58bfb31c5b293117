"""The laws that are monitored: which they are and under which title their text is published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (law_id, title). Fixed values; texts are never kept here.
LAWS = (
    (2000596, "חוק השכירות והשאילה"),
    (2000292, "חוק החוזים (חלק כללי)"),
    (2000293, "חוק החוזים (תרופות בשל הפרת חוזה)"),
    (2000390, "חוק המכר"),
    (2000416, "חוק המקרקעין"),
    (2000489, "חוק הערבות"),
    (2000295, "חוק החוזים האחידים"),
    (2000428, "חוק המתווכים במקרקעין"),
    (2000230, "חוק הגנת הדייר"),
    (2001155, "חוק עשיית עושר ולא במשפט"),
    (2001168, "חוק פסיקת ריבית והצמדה"),
    (2000237, "חוק הגנת הצרכן"),
    (2000633, "חוק זכויות הדייר בדיור הציבורי"),
)


def laws(spark: SparkSession, listed: tuple[tuple[int, str], ...] = LAWS) -> DataFrame:
    """(law_id, title)."""
    return spark.createDataFrame(list(listed), "law_id long, title string")


def monitored(rows: DataFrame, listed: tuple[tuple[int, str], ...] = LAWS, key: str = "law_id") -> DataFrame:
    """The rows of laws that are monitored, with their title. The catalog is a short list of the program, so it is broadcast."""
    return rows.join(F.broadcast(laws(rows.sparkSession, listed).withColumnRenamed("law_id", key)), key)


def unseen(rows: DataFrame, listed: tuple[tuple[int, str], ...] = LAWS, key: str = "law_id") -> DataFrame:
    """(law_id, title) of monitored laws that have no row."""
    return laws(rows.sparkSession, listed).join(rows.select(F.col(key).alias("law_id")).distinct(), "law_id", "left_anti")
