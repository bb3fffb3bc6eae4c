"""Version, period and status of a file from its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of versions, periods and dates in file names, months, and words of status and kind.
VERSION = r"[vV](\d+(?:\.\d+)*)"
QUARTER = r"(?i)(Q[1-4])\s*(\d{4})"
MONTH = (
    r"(?i)\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?"
    r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(\d{4})\b"
)
SHORT_MONTH = r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[\-_ ]+(\d{2,4})\b"
FISCAL_YEAR = r"(?:FY|fy)\s*(\d{4})"
YEAR = r"[_\-\s](\d{4})[_\-\s]"
ISO_DATE = r"(\d{4})[\-_](\d{2})[\-_](\d{2})"
DOTTED_DATE = r"\b(\d{1,2})\.(\d{1,2})\.(\d{2,4})\b"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
CURRENT_WORDS = "final|latest|current|updated"
FIRST_YEAR, LAST_YEAR = 2000, 2030
KINDS = (
    ("investor-day", "investor day|investor event|analyst day|annual meeting"),
    ("merger-presentation", "merger|acquisition|transaction|business combination"),
    ("quarterly-update", r"quarterly|company update|earnings update|\bq[1-4]\b"),
)


def _full_year(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


def version_group(name: Column) -> Column:
    """The name without its version, period and date, separators as ``_``, without extension, lower-cased."""
    for p in ("(?i)" + VERSION, QUARTER, MONTH, SHORT_MONTH, ISO_DATE, DOTTED_DATE):
        name = F.regexp_replace(name, p, "")
    name = F.regexp_replace(F.regexp_replace(name, r"[_\-\s]+", "_"), r"^[_.]+|[_.]+$", "")
    return F.nullif(F.lower(F.regexp_replace(name, r"\.[^.]+$", "")), F.lit(""))


def resolve(files: DataFrame, name: str = "file_name", preview: Column | None = None) -> DataFrame:
    """``files`` with version_label, version_group, version_rank, effective_from, effective_to, published_at, is_current,
    confidence and document_type. The first of quarter, month, short month and year that applies sets rank and period."""
    n = F.col(name)
    both = F.concat(n, F.lit(" "), F.substring(F.coalesce(preview if preview is not None else F.lit(""), F.lit("")), 1, 500))
    found = files.withColumn("_both", both)
    text = F.col("_both")
    get = lambda c, pattern, k: F.regexp_extract(c, pattern, k)
    # What the patterns find, once each; the rules below only choose among these.
    found = found.withColumns(
        {
            "_low": F.lower(text),
            "_version": F.nullif(get(n, VERSION, 1), F.lit("")),
            "_q": F.upper(get(text, QUARTER, 1)),
            "_q_year": get(text, QUARTER, 2).try_cast("int"),
            "_m": get(text, MONTH, 1),
            "_m_year": get(text, MONTH, 2).try_cast("int"),
            "_s": get(text, SHORT_MONTH, 1),
            "_s_year": _full_year(get(text, SHORT_MONTH, 2).try_cast("int")),
            "_year": F.coalesce(F.nullif(get(text, FISCAL_YEAR, 1), F.lit("")), get(n, YEAR, 1)).try_cast("int"),
            "_iso": F.concat_ws("-", *(get(n, ISO_DATE, k) for k in (1, 2, 3))),
            "_dot": F.concat_ws("-", _full_year(get(n, DOTTED_DATE, 3).try_cast("int")).cast("string"), F.lpad(get(n, DOTTED_DATE, 1), 2, "0"), F.lpad(get(n, DOTTED_DATE, 2), 2, "0")),
        }
    )
    months = F.array(*(F.lit(m[:3].lower()) for m in MONTHS))
    number = lambda c: F.array_position(months, F.lower(F.substring(c, 1, 3))).cast("int")
    in_range = lambda c: F.col(c).between(FIRST_YEAR, LAST_YEAR)
    c = F.col
    found = found.withColumn("_kind", F.when(c("_q_year").isNotNull(), 1).when(in_range("_m_year"), 2).when(in_range("_s_year"), 3).when(in_range("_year"), 4).otherwise(0))
    kind = c("_kind")
    found = found.withColumns(
        {
            "_y": F.when(kind == 1, c("_q_year")).when(kind == 2, c("_m_year")).when(kind == 3, c("_s_year")).when(kind == 4, c("_year")),
            # First and last month of the period.
            "_from": F.when(kind == 1, F.substring("_q", 2, 1).try_cast("int") * 3 - 2).when(kind == 2, number(c("_m"))).when(kind == 3, number(c("_s"))).when(kind == 4, 1),
            "_date": F.when(c("_iso") != "--", c("_iso").try_cast("date")).otherwise(c("_dot").try_cast("date")),
            "_current": c("_low").rlike(CURRENT_WORDS),
        }
    )
    last = F.when(kind == 1, c("_from") + 2).when(kind == 4, 12).otherwise(c("_from"))
    spoken = F.when(kind == 2, c("_m")).otherwise(F.element_at(F.array(*map(F.lit, MONTHS)), F.coalesce(c("_from"), F.lit(1))))
    label = F.when(kind == 1, F.concat_ws(" ", "_q", c("_y").cast("string"))).when(kind.isin(2, 3), F.concat_ws(" ", spoken, c("_y").cast("string"))).when(kind == 4, c("_y").cast("string"))
    rank = F.when(kind == 1, c("_y") * 10 + F.ceil(c("_from") / 3)).when(kind.isin(2, 3), c("_y") * 100 + c("_from")).when(kind == 4, c("_y")).otherwise(F.coalesce(F.substring_index("_version", ".", 1).try_cast("bigint"), F.lit(0)))
    when = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    sure = F.when(kind == 1, 0.7).when(kind.isin(2, 3), 0.65).when(kind == 4, 0.5).otherwise(0.0)
    document_type = F.lit(None).cast("string")
    for name_of, pattern in reversed(KINDS):
        document_type = F.when(c("_low").rlike(pattern), name_of).otherwise(document_type)
    return found.select(
        *files.columns,
        F.coalesce(F.concat(F.lit("v"), "_version"), label).alias("version_label"),
        version_group(n).alias("version_group"),
        rank.cast("bigint").alias("version_rank"),
        F.make_date("_y", "_from", F.lit(1)).alias("effective_from"),
        F.make_date("_y", last, F.when(kind == 4, 31).otherwise(28)).alias("effective_to"),
        c("_date").alias("published_at"),
        c("_current").alias("is_current"),
        F.greatest(when(c("_version").isNotNull(), 0.8), sure, when(c("_date").isNotNull(), 0.6), when(c("_current"), 0.6)).alias("confidence"),
        document_type.alias("document_type"),
    )
