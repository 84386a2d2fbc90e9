"""Pages as blocks by a table function, and their sections."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from evidentia.functions import text as X
from evidentia.operators.sectioning import assembled, cut, name_title, plain

# Tags whose content is dropped, and tags that make a block.
SKIPPED = {"script", "style", "nav", "footer", "header", "aside"}
BLOCKS = {"p", "li", "pre", "blockquote", "code"}
HEADINGS = {f"h{n}": n for n in range(1, 7)}
_CLOSES_P = {"div", "article", "section", "main", "ul", "ol", "table", "body", "html"} | BLOCKS | set(HEADINGS)
_BLOCK = T.StructType(
    [T.StructField("tag", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]
)
_PAGE = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("loose", T.StringType()), T.StructField("blocks", T.ArrayType(_BLOCK))]
)


class _Blocks(HTMLParser):
    """Blocks in order as (tag, their pieces of text); a block inside another one belongs to that."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.tag, self.depth, self.lists, self.held = [], None, 0, 0, []
        self.blocks, self.loose, self.title, self.in_title = [], [], [], False

    def close_block(self):
        if self.tag:
            self.blocks.append((self.tag, self.held))
        self.tag, self.held, self.depth, self.lists = None, [], 0, 0

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in SKIPPED:
            self.skip += [tag] if tag in SKIPPED else []
            return
        self.in_title = tag == "title"
        if self.tag == "li" and tag in ("ul", "ol"):
            self.lists += 1
        if self.tag == "li" and tag == "li" and self.lists:  # of a list within this item
            return
        if self.tag == "p" and tag in _CLOSES_P and tag != "code" or tag == self.tag == "li" or self.tag in HEADINGS and tag in HEADINGS:
            self.close_block()
        if tag == self.tag:
            self.depth += 1
        elif self.tag is None and (tag in BLOCKS or tag in HEADINGS):
            self.tag, self.depth = tag, 1

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
            return
        self.in_title = False
        if self.tag == "li" and tag in ("ul", "ol"):
            if not self.lists:
                self.close_block()
            self.lists = max(0, self.lists - 1)
        elif self.tag == "li" and tag == "li" and self.lists:
            return
        elif tag == self.tag:
            self.depth -= 1
            if not self.depth:
                self.close_block()
        elif self.tag == "p" and tag in _CLOSES_P - {"code"}:
            self.close_block()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            (self.held if self.tag else self.loose).append(data)


def _spoken(pieces: list[str]) -> str:
    return " ".join(filter(None, map(str.strip, pieces)))


class PageBlocks:
    """page_blocks(html): one row a page with its title, the text outside of blocks, and its blocks as (tag, level of a heading or 0,
    text), blanks as they are. In SQL: SELECT ... FROM pages p, LATERAL page_blocks(p.html) b."""

    @staticmethod
    def analyze(page: AnalyzeArgument) -> AnalyzeResult:
        if page.dataType != T.StringType():
            raise ValueError(f"page_blocks takes a string, not {page.dataType.simpleString()}")
        return AnalyzeResult(schema=_PAGE)

    def eval(self, page: str):
        read = _Blocks()
        read.feed((page or "").replace("\r\n", "\n").replace("\r", "\n"))
        read.close()
        read.close_block()
        blocks = [(tag, HEADINGS.get(tag, 0), "\n".join(held) if tag == "pre" else _spoken(held)) for tag, held in read.blocks]
        yield _spoken(read.title), _spoken(read.loose), blocks


def register(spark: SparkSession, name: str = "page_blocks") -> None:
    """Makes page_blocks known to SQL."""
    spark.udtf.register(name, F.udtf(PageBlocks))


def with_sections(docs: DataFrame, text_col: str = "text", name_col: str = "name") -> DataFrame:
    """docs without the two columns, with rows: the array of (section_index, section_path, heading, text) of each page.

    A page without text under its headings is one section of its headings, or else of all its text. Other columns must not have names that
    begin with an underscore.
    """
    spark = docs.sparkSession
    register(spark)
    keep = [c for c in docs.columns if c not in (text_col, name_col)]
    source = docs.select(*keep, F.col(name_col).alias("_name"), F.col(text_col).cast("string").alias("_page"))
    df = spark.sql("SELECT d.*, b.* FROM {docs} d, LATERAL page_blocks(d._page) b", docs=source).drop("_page")
    raw = F.concat(F.array(*[F.struct(F.lit("").alias("tag"), F.lit(0).alias("level"), F.col(c).alias("text")) for c in ("title", "loose")]), "blocks")
    clean = F.transform(
        raw, lambda b: F.struct(
            b["level"].alias("level"), plain(b["text"], b["tag"] == "pre").alias("text"), b["tag"].isin("h1", "h2").alias("top")
        )
    )
    df = df.withColumn("_all", X.once(clean))
    df = df.withColumn("_blocks", X.once(F.slice("_all", F.lit(3), F.size("_all")))).drop("blocks", "title", "loose")
    df = df.withColumn("_places", X.once(F.array_compact(F.transform("_blocks", lambda b, i: F.when(b["level"] > 0, i)))))
    first = F.get(F.filter("_blocks", lambda b: b["top"] & (b["text"] != "")), F.lit(0))["text"]
    title = F.coalesce(F.nullif(F.get("_all", F.lit(0))["text"], F.lit("")), first, name_title(F.col("_name")))
    joined = lambda blocks: F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t != ""), "\n\n")
    under = cut(
        F.col("_blocks"), F.col("_places"),
        lambda k, blocks: joined(F.when(k == 0, blocks).otherwise(F.slice(blocks, F.lit(2), F.size(blocks))))
    )
    everything = joined(F.col("_blocks"))
    df = df.withColumn("_heads", F.filter("_blocks", lambda b: b["level"] > 0)).withColumn("_title", X.once(title)).withColumn(
        "_texts", X.once(under)
    )
    return assembled(df, keep, X.let(everything, lambda t: F.when(t != "", t).otherwise(F.get("_all", F.lit(1))["text"])))
