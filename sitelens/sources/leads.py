"""Lead lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.text import strip

COLUMNS = ("company_name", "site_url", "industry", "email", "comment")
# Known industries; anything else reads as auto.
INDUSTRIES = ("auto", "медицина", "образование", "IT/SaaS", "e-commerce", "услуги", "финансы", "HR/рекрутинг",
              "недвижимость", "туризм", "другое")


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; only site_url (or url) is required, all values stay text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


MODES = ("quick", "full")


def normalize_leads(df: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Trimmed leads, one row per stable site_id; rows without a URL are left out. Of rows with one id
    the first by their columns stays, with the largest page budget (NULL: no limit) of them."""
    have = set(df.columns)

    def text(c):
        if c not in have:
            return F.lit("")
        t = strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(F.lower(t) == "nan", "").otherwise(t)

    url = F.when(text("site_url") != "", text("site_url")).otherwise(text("url"))
    industry = F.when(text("industry").isin(*INDUSTRIES), text("industry")).otherwise("auto")
    out = df.select(
        *([F.col("site_id").cast("string")] if "site_id" in have else []),
        text("company_name").alias("company_name"), url.alias("site_url"), industry.alias("industry"),
        text("email").alias("email"), text("comment").alias("comment"),
        F.when(text("scan_mode").isin(*MODES), text("scan_mode")).otherwise(MODES[0]).alias("scan_mode"),
        (F.coalesce(F.col("max_pages").cast("int"), F.lit(max_pages)) if "max_pages" in have
         else F.lit(max_pages)).cast("int").alias("max_pages"),
    ).where("site_url <> ''")
    if "site_id" not in have:
        out = out.withColumn("site_id", F.substring(F.sha2(F.concat_ws("\x1f", *COLUMNS), 256), 1, 12))
    unlimited = F.bool_or(F.col("max_pages").isNull())
    first = out.groupBy("site_id").agg(F.min(F.struct(*COLUMNS, "scan_mode")).alias("m"), F.when(~unlimited, F.max("max_pages")).alias("max_pages"))
    return first.select("site_id", "m.*", "max_pages")
