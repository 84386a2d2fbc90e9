"""From a manifest to sections, chunks and the corpus report."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidentia.functions import text as X
from evidentia.operators import sections as S
from evidentia.sources import tables
from evidentia.sources.files import with_files
from evidentia.sources.tables import kept

#: Our own default; callers name their site.
SITE = "https://docs.example.org/"


def admitted(path: Column, allowed: list[str], denied: list[str]) -> Column:
    """Markdown files under an allowed folder and under no denied one."""
    under = lambda p: path.startswith(p + "/")
    any_of = lambda ps: functools.reduce(operator.or_, [under(p) for p in ps], F.lit(False))
    return path.rlike(r"\.mdx?$") & ~any_of(denied) & any_of(allowed)


def doc_id_of(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/", "-")


def source_url_of(path: Column, site: str = SITE, root: str = "docs") -> Column:
    """The address of a file: the site, its folders from the first one named `root` on, and its name
    without the last suffix; a path without such a folder is an error when read."""
    parts = F.split(path, "/")
    at = F.array_position(parts, root).cast("int")
    no_root = F.raise_error(F.concat(F.lit(f"no folder {root} in "), path)).cast("int")
    folders = F.slice(parts, F.when(at > 0, at).otherwise(no_root), F.size(parts) - F.greatest(at, F.lit(1)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]+$", "")
    return F.concat(F.lit(site), F.array_join(F.concat(folders, F.array(stem)), "/"), F.lit("/"))


def is_allowed(manifest: DataFrame) -> Column:
    """Whether a record's `allowed` holds: absent it does, null it does not, a text does unless empty, a number unless 0."""
    if "allowed" not in manifest.columns:
        return F.lit(True)
    kind, value = manifest.schema["allowed"].dataType, F.col("allowed")
    test = value != "" if isinstance(kind, StringType) else value.cast("boolean")
    return F.coalesce(test, F.lit(False))


#: Fields of a manifest's record that its sections have, too.
_CARRIED = ("snapshot_id", "source_path", "source_url", "license", "attribution", "language")


def parsed(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """The sections of all allowed records, in the columns of tables.SECTIONS.

    manifest: the columns of tables.MANIFEST; texts: path, text, one row a file. A record without a file is an
    error when read; a document without any text has no sections. Sections are ordered by (source_path, doc_id, section_index) where
    order is asked for; nothing here sorts them.
    """
    wanted = manifest.where(is_allowed(manifest))
    files = texts.select(F.col("path").alias("_path"), F.coalesce("text", F.lit("")).alias("_text"))
    return _sectioned(wanted.join(files, F.col("source_path") == F.col("_path"), "left"), manifest)


def parsed_files(manifest: DataFrame, root: str) -> DataFrame:
    """parsed() of the files below root: only those of allowed records are opened, each in the task that has its record, and no text
    is shuffled."""
    return _sectioned(with_files(manifest.where(is_allowed(manifest)), root, "source_path", "_text"), manifest)


def _sectioned(full: DataFrame, manifest: DataFrame) -> DataFrame:
    missing = F.raise_error(F.concat(F.lit("no file for "), F.col("source_path"))).cast("string")
    full = full.withColumn("_text", F.coalesce("_text", missing))
    carried = tuple(c for c in _CARRIED if c in manifest.columns)
    rows = S.sections(full, S.BY_NAME, "doc_id", "_text", "source_path", titled=True, carried=carried)
    of = lambda c: (F.col(c) if c in manifest.columns else F.lit(None).cast("string")).alias(c)
    language = F.coalesce(of("language"), F.lit("en")).alias("language")
    return rows.select(
        of("snapshot_id"), of("doc_id"), "section_id", F.col("section_index").cast("int").alias("section_index"), "doc_title", "heading",
        "section_path", of("source_path"), of("source_url"), of("license"), of("attribution"), language,
        F.col("start_offset").cast("int").alias("start_offset"), F.col("end_offset").cast("int").alias("end_offset"), "text"
    )


def in_manifest_order(rows: DataFrame) -> DataFrame:
    """Sections or chunks as a file of them is ordered: by path, document, section and chunk."""
    return rows.orderBy("source_path", "doc_id", *[c for c in ("section_index", "chunk_index") if c in rows.columns])


def chunked_sections(sections: DataFrame, most: int = 350, overlap: int = 50) -> DataFrame:
    """The chunks of sections (tables.SECTIONS), in the columns of tables.CHUNKS; offsets count from the document's beginning."""
    rows = chunks(
        sections, "doc_id", "text", most, overlap, base="start_offset", digest=("snapshot_id", "doc_id", "section_id"),
        keep=tuple(c for c in sections.columns if c not in ("doc_id", "text", "start_offset", "end_offset", "heading"))
    )
    names = [f.split()[0] for f in tables.CHUNKS.split(", ")]
    number = lambda c: F.col(c).cast("int").alias(c) if c in (
        "chunk_index", "start_offset", "end_offset", "token_count"
    ) else F.col(c)
    return rows.select(*[number(c) for c in names])


def single_snapshot(chunks: DataFrame) -> str | None:
    """The one snapshot id of chunks, null where they have none or several."""
    own = F.when(~X.blank(F.col("snapshot_id")), F.col("snapshot_id"))
    row = chunks.agg(F.min(own).alias("lo"), F.max(own).alias("hi")).first()
    return row["lo"] if row["lo"] == row["hi"] else None


def registry(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, id): the different documents, sections and chunks that a corpus has."""
    pick = lambda df, kind: df.where(~X.blank(F.col(f"{kind}_id"))).select(
        F.lit(kind).alias("kind"), X.stripped(F.col(f"{kind}_id")).alias("id")
    )
    every = [pick(sections, "doc"), pick(chunks, "doc"), pick(sections, "section"), pick(chunks, "section"), pick(chunks, "chunk")]
    return functools.reduce(DataFrame.union, every).distinct()


def occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with occurrence: the place of each among those of its key, by order, from 1.

    Rows are sorted over all tasks by (key, order), so that a key of very many rows is spread
    over several; a task numbers what it has, and only its counts of keys are added up.
    """
    part = kept(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    counts = part.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).where("_before > 0").select(
        F.col(key).alias("_key"), F.col("_part").alias("_of"), "_before"
    )
    local = F.row_number().over(Window.partitionBy("_part", key).orderBy(order))
    out = part.withColumn("_local", local).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")), "left")
    return out.withColumn("occurrence", (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long")).drop(
        "_part", "_local", "_key", "_of", "_before"
    )


def section_offsets(sections: DataFrame, doc: str = "doc_id", index: str = "section_index", text: str = "text", gap: int = 2) -> DataFrame:
    """Adds start_offset and end_offset: sections end to end with a gap."""
    before = Window.partitionBy(doc).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0))
    return sections.withColumn("start_offset", start.cast("long")).withColumn("end_offset", F.col("start_offset") + F.length(text))


def chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 350, overlap: int = 50, base: str | None = None,
    digest: tuple[str, ...] = (), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Windows of `most` tokens that overlap: (id, chunk_index, start_offset, end_offset, token_count, text, chunk_id) and the columns in keep.

    Offsets count from that in the column base, or 0. A chunk id ends in a digest of the columns in digest (the
    id unless given), its number and its offsets. A text is read once, and a window carries nothing but its own words.
    """
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("need 0 <= overlap < most")
    stride = most - overlap
    own = {f"_{c}": F.col(c) for c in digest}
    start = F.col(base).cast("long") if base else F.lit(0).cast("long")
    segs = X.once(X.found(F.coalesce(F.col(text_col), F.lit("")), X.SEGMENT)).alias("segs")
    segments = docs.select(F.col(id_col), *keep, *[c.alias(n) for n, c in own.items()], start.alias("_base"), segs)
    n = F.size("segs")
    last = F.greatest(F.lit(0), F.ceil((n - most) / stride)).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def window(i):
        at = i * stride + 1
        words = lambda k: F.array_join(F.slice("segs", at, F.lit(k)), "")
        return F.struct(
            i.alias("i"), words(most).alias("raw"), F.length(words(stride)).cast("long").alias("size"),
            F.least(F.lit(most), n - at + 1).cast("long").alias("tokens")
        )

    windows = segments.select(id_col, *keep, *own, "_base", X.once(F.transform(numbers, window)).alias("windows"))
    # Where each window begins: the lengths of the strides before it.
    sums = F.aggregate("windows", F.array(F.lit(0).cast("long")), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + w["size"])))
    rows = windows.withColumn("before", sums).select(id_col, *keep, *own, "_base", "before", F.explode("windows").alias("w"))
    text = F.regexp_replace("w.raw", rf"^[{X.WS}]+", "")
    end = F.col("_base") + F.element_at("before", F.col("w.i") + 1) + F.length("w.raw")
    rows = rows.select(
        id_col, *keep, *own, F.col("w.i").cast("long").alias("chunk_index"), text.alias("text"), end.alias("end_offset"),
        F.col("w.tokens").alias("token_count")
    )
    rows = rows.withColumn("start_offset", F.col("end_offset") - F.length("text"))
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*(own or [id_col]), "chunk_index", "start_offset", "end_offset")]
    code = F.substring(F.sha1(F.concat_ws("|", *told)), 1, 12)
    rows = rows.withColumn(
        "chunk_id", F.concat(F.col(id_col).cast("string"), F.lit("-chk-"), F.format_string("%04d", F.col("chunk_index")), F.lit("-"), code)
    )
    return rows.select(id_col, *keep, "chunk_index", "start_offset", "end_offset", "token_count", "text", "chunk_id")


def report(chunked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: documents, chunks, duplicate ids, empty texts, bad offsets, token total."""
    ids = F.coalesce("chunk_id", F.lit(""))
    return chunked.agg(
        F.countDistinct(id_col).alias("documents"),
        F.count("*").alias("chunks"),
        (F.count("*") - F.countDistinct(ids)).alias("duplicate_ids"),
        F.coalesce(F.sum(X.blank(F.col("text")).cast("long")), F.lit(0)).alias("empty_texts"),
        F.coalesce(F.sum((F.col("start_offset") >= F.col("end_offset")).cast("long")), F.lit(0)).alias("bad_offsets"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("estimated_tokens"),
    )
