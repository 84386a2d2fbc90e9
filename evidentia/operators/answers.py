"""Claims of an answer, checks of its citations, repair, prompts and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import corpus
from evidentia.sources.storage import kept

# What ends a sentence (abbreviations do not), bullets, and texts that read as a refusal.
ABBREVIATIONS = ("e.g", "i.e", "etc", "mr", "mrs", "ms", "dr", "vs")
REFUSAL_CUES = (
    "can't answer", "cannot answer", "do not know", "don't know", "no relevant documentation", "no relevant docs", "insufficient evidence",
    "out of scope", "approved support corpus"
)
BULLET = rf"^[ \t]*(?:[-*+]|\d+[.)])[{X.WS}]+[^{X.WS}]"
_FULL_STOP = r"(?<!" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\."
SENTENCE = rf"(?is)[{X.WS}]*[^{X.WS}].*?(?:(?:[!?]|{_FULL_STOP})(?=[{X.WS}]|\z)|\z)"
CITATIONS = "array<struct<marker:string,doc_id:string,chunk_id:string,start_offset:int,end_offset:int>>"

#: Our own wording; callers may pass other texts by reason code.
MESSAGES = {
    "no_relevant_docs": "The approved support corpus holds nothing on this question.",
    "insufficient_evidence": "The approved support corpus has insufficient evidence for this question.",
    "citation_validation_failed": "I cannot answer: no answer with sound citations was found.",
    "out_of_scope": "I cannot answer: the question is out of scope of the approved support corpus.",
}


def claims(answers: DataFrame, id_col: str, text_col: str = "answer") -> DataFrame:
    """(id, claim_index, kind, text, start_offset, end_offset): one row per bullet line or sentence."""
    lines = answers.select(  # with their ends
        id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?<=\n)|(?<=\r)(?!\n)")).alias("line", "text")
    )
    lines = corpus.section_offsets(lines, id_col, "line", gap=0)
    bullet = F.col("text").rlike(BULLET)
    parts = lines.select(
        id_col, "line", "start_offset", bullet.alias("bullet"),
        F.when(bullet, F.array("text")).otherwise(X.found(F.col("text"), SENTENCE)).alias("parts")
    )
    rows = parts.select("*", F.posexplode("parts").alias("part", "raw"))
    before = F.length(F.array_join(F.slice("parts", F.lit(1), F.col("part")), ""))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", rf"^[{X.WS}]+", ""))
    text = X.stripped(F.col("raw"))
    rows = rows.select(
        id_col, "line", "part", F.when(F.col("bullet"), "bullet").otherwise("sentence").alias("kind"), text.alias("text"),
        (F.col("start_offset") + before + lead).alias("start_offset")
    )
    order = Window.partitionBy(id_col).orderBy("line", "part")
    rows = rows.where("text <> ''").withColumn("claim_index", F.row_number().over(order) - 1)
    return rows.select(
        id_col, "claim_index", "kind", "text", "start_offset", (F.col("start_offset") + F.length("text")).alias("end_offset")
    )


def _failure(code: str, claim: Column | None = None, marker: Column | None = None) -> list[Column]:
    none = F.lit(None)
    return [
        F.lit(code).alias("code"), (none if claim is None else claim).cast("int").alias("claim_index"),
        (none if marker is None else marker).cast("string").alias("marker")
    ]


def failures(answers: DataFrame, contexts: DataFrame, id_col: str) -> DataFrame:
    """(id, code, claim_index, marker) for what is wrong with answers that are no refusals.

    answers: id, answer, citations; contexts: id, chunk_id, text, start_offset, end_offset.
    """
    records = answers.select(id_col, F.posexplode("citations").alias("at", "c")).select(id_col, "at", "c.*")
    sound = F.col("marker").rlike(r"^\[\d+\]$")
    ranked = records.where(sound).withColumn("nth", F.row_number().over(Window.partitionBy(id_col, "marker").orderBy("at")))
    out = records.where(~F.coalesce(sound, F.lit(False))).select(id_col, *_failure("malformed_citation_marker", marker=F.col("marker")))
    out = out.union(ranked.where("nth > 1").select(id_col, *_failure("duplicate_citation_marker", marker=F.col("marker"))))

    said = claims(answers, id_col).select(
        id_col, "claim_index", F.array_distinct(X.found(F.col("text"), X.MARKER)).alias("valid"),
        F.filter(X.found(F.col("text"), X.BRACKET), lambda m: ~m.rlike(r"^\[\d+\]$")).alias("odd")
    )
    out = out.union(
        said.select(id_col, "claim_index", F.explode("odd").alias("m")).select(
            id_col, *_failure("malformed_citation_marker", F.col("claim_index"), F.col("m"))
        )
    )
    out = out.union(said.where(F.size("valid") == 0).select(id_col, *_failure("missing_citation_coverage", F.col("claim_index"))))

    used = said.select(id_col, "claim_index", F.explode("valid").alias("marker"))
    held = ranked.where("nth = 1").select(id_col, "marker", "chunk_id", "start_offset", "end_offset", F.lit(True).alias("known"))
    seen = contexts.groupBy(id_col, "chunk_id").agg(
        F.max_by(
            F.struct(F.length("text").alias("size"), F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi")), "start_offset"
        ).alias("ctx")
    )
    full = used.join(held, [id_col, "marker"], "left").join(seen, [id_col, "chunk_id"], "left")
    code = (
        F.when(F.col("known").isNull(), "unknown_citation_marker")
        .when(F.col("ctx").isNull(), "non_retrieved_chunk")
        .when(
            (F.col("end_offset") > F.col("ctx.size")) | (F.col("start_offset") < 0) | (
                F.col("ctx.lo") + F.col("end_offset") > F.col("ctx.hi")
            ),
            "offset_out_of_range"
        )
    )
    wrong = full.withColumn("code", code).where("code is not null")
    return out.union(wrong.select(id_col, "code", F.col("claim_index").cast("int"), "marker"))


def validated(answers: DataFrame, contexts: DataFrame, id_col: str) -> DataFrame:
    """Adds failures (sorted structs) and outcome: valid, retry, or for a refusal that contradicts itself refuse.

    answers also has is_refusal and message; a null is_refusal counts as false. A blank answer that is no refusal is to be retried.
    """
    refusal = F.coalesce(F.col("is_refusal"), F.lit(False))
    found = failures(answers.where(~refusal), contexts, id_col).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("claim_index", "code", "marker"))).alias("found")
    )
    answer, text = X.stripped(F.coalesce("answer", F.lit(""))), F.lower("answer")
    cue = F.coalesce(text.rlike("|".join(REFUSAL_CUES)), F.lit(False))
    contradicts = (answer != X.stripped(F.coalesce("message", F.lit("")))) | F.coalesce(
        F.col("answer").rlike(X.BRACKET), F.lit(False)
    ) | ~cue
    one = lambda code: F.array(
        F.struct(F.lit(None).cast("int").alias("claim_index"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("marker"))
    )
    none = F.filter(one(""), lambda x: F.lit(False))
    got = F.when(
        refusal, F.when(contradicts, one("refusal_answer_contradiction")).otherwise(none)
    ).when(answer == "", one("blank_answer")).otherwise(F.coalesce("found", none))
    full = answers.join(found, id_col, "left").withColumn("failures", got).drop("found")
    return full.withColumn("outcome", F.when(F.size("failures") == 0, "valid").when(refusal, "refuse").otherwise("retry"))


def with_marker(text: Column, marker: Column) -> Column:
    """The marker before the final punctuation, or at the end where there is none."""
    bare = F.regexp_replace(text, rf"[{X.WS}]*[.!?]$", "")
    return F.concat(bare, F.lit(" "), marker, F.regexp_extract(text, r"([.!?]?)\z", 1))


def repaired(checked: DataFrame, id_col: str) -> DataFrame:
    """Answers of validated() whose only failures are uncited claims get their first marker there; others stay.

    What is read several times, the checked answers here and the repaired ones by a later check, is kept.
    """
    checked = kept(checked)
    only = F.forall("failures", lambda f: f.code == "missing_citation_coverage") & (F.size("failures") > 0) & (F.size("citations") > 0)
    marker = F.col("citations")[0]["marker"]
    todo = checked.where(only)
    spans = claims(todo, id_col).join(todo.select(id_col, marker.alias("m")), id_col)
    new = F.when(F.size(X.found(F.col("text"), X.MARKER)) == 0, with_marker(F.col("text"), F.col("m"))).otherwise(F.col("text"))
    spans = spans.groupBy(id_col).agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col("start_offset").cast("int").alias("lo"), F.col("end_offset").cast("int").alias("hi"), new.alias("new"))
            )
        ).alias("spans")
    )
    answer = F.col("answer")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda s, c: F.struct(
        c.hi.alias("at"), F.concat(s.text, F.substring(answer, s.at + 1, c.lo - s.at), c.new).alias("text")
    )
    built = F.aggregate("spans", start, step, lambda s: F.concat(s.text, F.substring(answer, s.at + 1, F.length(answer))))
    return kept(
        checked.join(spans, id_col, "left").withColumn("answer", F.when(F.col("spans").isNotNull(), built).otherwise(answer)).drop("spans")
    )


def prompt_context(hits: DataFrame, id_col: str, chunk_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, n_blocks, context): the hits' texts as numbered blocks in rank order; the mark of a block's end is escaped in texts."""
    block = F.struct("rank", F.col(chunk_col).cast("string").alias("c"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = hits.groupBy(id_col).agg(F.array_sort(F.collect_list(block)).alias("b"))
    line = lambda x, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] chunk="), x.c, F.lit("\n<<<\n"), F.replace(x.t, F.lit(">>>"), F.lit(r"\>\>\>")), F.lit("\n>>>")
    )
    return rows.select(id_col, F.size("b").cast("long").alias("n_blocks"), F.array_join(F.transform("b", line), "\n\n").alias("context"))


def refusals(decisions: DataFrame, id_col: str, messages: dict[str, str] | None = None, next_step: str | None = None) -> DataFrame:
    """(id, reason_code, message) for the decisions that have a message; a next step follows it and ends in a mark."""
    known = messages or MESSAGES
    texts = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    if next_step is not None and not next_step.strip():
        raise ValueError("next_step must not be blank")
    step = (next_step or "").strip()
    tail = f" Next step: {step}" + ("" if step.endswith((".", "!", "?")) else ".") if step else ""
    rows = decisions.where(F.col("decision").isin(*known))
    return rows.select(
        id_col, F.col("decision").alias("reason_code"), F.concat(F.element_at(texts, F.col("decision")), F.lit(tail)).alias("message")
    )
