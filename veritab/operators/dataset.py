"""Building the record table: resume, merge, classification, curation, variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.functions import text as T
from veritab.sources import files

DONE = ("ok",)


def last_per_id(rows: DataFrame, key: str = "id", order: str = "row_no") -> DataFrame:
    """The last row of each id, with the place of its first occurrence (first_row). One map-side-combined aggregate."""
    others = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r"), F.min(order).alias("first_row"))
    return picked.select(key, "r.*", "first_row")


def done_ids(prior: DataFrame, key: str = "id", statuses: tuple[str, ...] = DONE) -> DataFrame:
    """Ids that any row marks as complete."""
    return prior.filter(F.col("fetch_status").isin(*statuses)).select(key).distinct()


def pending(records: DataFrame, prior: DataFrame, key: str = "id", statuses: tuple[str, ...] = DONE, overwrite: DataFrame | None = None) -> DataFrame:
    """Records to process: not done, or to be overwritten."""
    done = done_ids(prior, key, statuses)
    if overwrite is not None:
        done = done.join(overwrite.select(key).distinct(), key, "left_anti")
    return records.join(done, key, "left_anti")


def kept(prior: DataFrame, will_process: DataFrame, key: str = "id") -> DataFrame:
    """Prior rows, last of each id, that will not be processed again."""
    return last_per_id(prior, key).join(will_process.select(key).distinct(), key, "left_anti")


def update(records: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Right-biased row merge: where a detail row exists its columns replace the record's, with '' too."""
    shared = [c for c in details.columns if c != key]
    right = details.select(F.col(key), F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in shared])
    joined = records.join(right, key, "left")
    out = [F.col(key)]
    out += [(F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)) if c in shared else F.col(c)).alias(c) for c in records.columns if c != key]
    out += [F.col(f"__{c}").alias(c) for c in shared if c not in records.columns]
    return joined.select(*out)


def reuse(pending_rows: DataFrame, prior: DataFrame, images: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows merged from prior because their image exists, rows still to fetch). images has the ids with an image."""
    with_image = pending_rows.join(images.select(key).distinct(), key, "left_semi")
    prior_last = last_per_id(prior, key).drop("first_row", "row_no")
    known = prior_last.select(key)
    reused = update(with_image.join(known, key, "left_semi"), prior_last, key)
    return reused, pending_rows.join(reused.select(key), key, "left_anti")


def merge_metadata(records: DataFrame, prior: DataFrame, fetched: DataFrame, key: str = "id") -> DataFrame:
    """What a run leaves: untouched prior rows, and processed records updated by what was fetched.

    replace() swaps it in for the prior table, so a run that fails leaves the
    prior table; running again skips what is done.
    """
    todo = pending(records, prior, key)
    fresh = update(todo, fetched, key)
    return kept(prior, todo, key).drop("first_row").unionByName(fresh, allowMissingColumns=True)


def replace(rows: DataFrame, path: str, write: Callable[[DataFrame, str], None] = files.write_records) -> None:
    """Write rows beside the table at path and swap it in, so rows may be read from that table.

    A run that fails before the swap leaves the old table as it was; one that
    fails within it leaves the old table at path + ".old", which is put back
    first when the function is called again.
    """
    spark = rows.sparkSession
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    system = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = f"{path}.new", f"{path}.old"
    if system.exists(at(old)) and not system.exists(at(path)):
        system.rename(at(old), at(path))
    system.delete(at(new), True)
    write(rows, new)
    system.delete(at(old), True)
    if system.exists(at(path)) and not system.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be moved")
    if not system.rename(at(new), at(path)):
        raise OSError(f"{new} cannot be moved")
    system.delete(at(old), True)


def with_extra_columns(rows: DataFrame, extra: list[str] = C.EXTRA_COLUMNS) -> DataFrame:
    return rows.withColumns({c: F.lit("") for c in extra if c not in rows.columns})


def fetch_status(error: Column, captcha: Column, images: Column, image_error: Column, core: list[Column], skip_partials: bool = False) -> Column:
    """error, captcha, ok_partial (when partial ones are skipped), no_image, image_error, ok or ok_partial, in this order."""
    complete = F.forall(F.array(*[F.coalesce(c, F.lit("")) for c in core]), lambda x: x != "")
    out = F.when(error.isNotNull(), F.concat(F.lit("error: "), error)).when(captcha, "captcha")
    if skip_partials:
        out = out.when(~complete, "ok_partial")
    return (
        out.when(F.coalesce(images, F.lit(0)) == 0, "no_image").when(image_error.isNotNull(), F.concat(F.lit("image_error: "), image_error))
        .when(complete, "ok").otherwise("ok_partial")
    )


def details_from_pages(pages: DataFrame, key: str = "page_id", captcha: Column | None = None) -> DataFrame:
    """Named fields of parsed pages (key, fields map, image_urls, html), normalized as the record table holds them.

    captcha: whether a page is one, if known; pages need no html then.
    """
    get = lambda label: F.try_element_at("fields", F.lit(label))
    return pages.select(
        key, F.coalesce(get("BRAND NAME"), F.lit("")).alias("brand_name_detail"), F.coalesce(get("FANCIFUL NAME"), F.lit("")).alias("fanciful_name_detail"),
        T.page_net_contents(get("NET CONTENTS")).alias("net_contents"), T.page_alcohol(get("ALCOHOL CONTENT")).alias("alcohol_content"),
        F.size("image_urls").alias("image_count"), (T.is_captcha(F.col("html")) if captcha is None else captcha).alias("captcha"),
    )


def curate(master: DataFrame) -> DataFrame:
    """Originals that were fetched completely, with all of net contents, alcohol, brand and image path."""
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    return master.filter(filled("net_contents") & filled("alcohol_content") & filled("brand_name_detail") & filled("image_path") & (F.col("fetch_status") == "ok") & (F.col("variant_type") == "original"))


def lookup(rows: DataFrame, key: str, value: object, column: str, order: str = "row_no") -> object:
    """The first row's value (by `order`) for a key, or None."""
    return rows.filter(F.col(key) == F.lit(value)).agg(F.min_by(column, order)).first()[0]


def prefix(rows: DataFrame, most: int | None, order: str = "row_no") -> DataFrame:
    """The first rows by their ordinal (from 0)."""
    return rows if most is None else rows.filter(F.col(order) < most)


def eligible(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("fetch_status") == "ok") & (F.trim("image_path") != ""))


def originals(rows: DataFrame) -> DataFrame:
    picked = rows.filter(F.col("fetch_status").isin("ok", "ok_partial") & (F.trim("image_path") != ""))
    return picked.withColumns({"variant_type": F.lit("original"), "base_image": F.lit("")})


def exact_sample(rows: DataFrame, fraction: float, order: list[Column], at_least: int = 1) -> DataFrame:
    """Exactly max(at_least, floor(n * fraction)) rows, the first by `order` (a seeded hash); a top-n without a full sort."""
    n = rows.count()
    return rows.orderBy(*order).limit(min(n, max(at_least, int(n * fraction))))


def seeded(key: str, seed: int = 42) -> list[Column]:
    return [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]


def master(rows: DataFrame, existing: DataFrame, variants: DataFrame, key: str = "id") -> DataFrame:
    """Originals, existing variants, and new variants of rows that had none.

    variants: key, image_path, variant_type, base_image; the base row's other columns are copied.
    """
    had = existing.filter(F.coalesce("variant_type", F.lit("original")) != "original")
    new = variants.join(had.select(key).distinct(), key, "left_anti")
    base = rows.drop("image_path", "variant_type", "base_image")
    return originals(rows).unionByName(had, allowMissingColumns=True).unionByName(new.join(base, key), allowMissingColumns=True)


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with record_no (from 1, by `order`) and records (how many there are).

    Rows are sorted by range and numbered inside their partitions; each
    partition starts after those before it, so no task sees all rows.
    """
    from pyspark.sql import Window

    from veritab.sources.tables import written

    placed = rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.withColumns({"__part": F.shiftright("__at", 33), "__nth": F.col("__at").bitwiseAND(F.lit(2**33 - 1))}).drop("__at"), "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("records"))
    out = placed.join(F.broadcast(starts), "__part").withColumn("record_no", F.col("__start") + F.col("__nth") + 1)
    return out.drop("__part", "__nth", "__start")
