"""Questions and answers: extraction, location, de-duplication, official view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.functions.positions import match_positions

# Marks of a question, of an answer, and of a speaker at the start of a line.
QUESTION = "(?m)^[ \\t]*(?:[●◆■◇○〇]\\s*)?(?:(?:Q|Ｑ|q|ｑ|问|問|提问|問題|質問)\\s*[：:])[ \\t]*"
ANSWER = "(?<![A-Za-z0-9])(?:[AＡaａ]\\s*[：:]|(?:答|回答)\\s*[：:])[ \\t]*"
SPEAKER = "(?m)^[ \\t]*([^：:\\n]{1,20})[：:]"
MARK_NAME = "^(?:Q|Ｑ|q|ｑ|问|問|提问|問題|質問|A|Ａ|a|ａ)$"


def turns_to_qa(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, q, a)``: each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = conversations.withColumns({"next_role": F.lead("role").over(w), "a": F.lead("text").over(w)})
    return d.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("q"), "a")


def speaker_counts(blocks: DataFrame, least: int = 2) -> DataFrame:
    """``(doc, speaker, n)`` of the names that open ``least`` or more lines of a document."""
    names = blocks.select("doc", F.explode(F.regexp_extract_all("text", F.lit(SPEAKER), F.lit(1))).alias("speaker"))
    names = names.select("doc", F.trim("speaker").alias("speaker")).where((F.col("speaker") != "") & ~F.col("speaker").rlike(MARK_NAME))
    return names.groupBy("doc", "speaker").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def extract_qa(blocks: DataFrame) -> DataFrame:
    """``(doc, start, end, q, a)`` of marked questions and answers in a document's blocks, ``end`` exclusive.

    A question runs to the first answer mark, or else the first name of a speaker, behind it in its
    block; the answer then to the next question of the block or the block's end, a speaker's name
    included. A name counts as the end of a question only behind a question mark, or when it opens two
    or more lines of the document, or is an answer's; a question with another name behind it is left
    out. Without either the answer is what follows in the blocks up to the next question. Both sides
    need two characters besides punctuation.
    """
    d = blocks.select("doc", "ord", F.coalesce("text", F.lit("")).alias("text"))
    sized = F.arrays_zip(match_positions(F.col("text"), QUESTION).alias("at"), F.regexp_extract_all("text", F.lit(QUESTION), F.lit(0)).alias("mark"))
    marks = d.where(F.col("text").rlike(QUESTION)).select("doc", "ord", "text", F.explode(sized).alias("m"))
    w = Window.partitionBy("doc", "ord").orderBy("at")
    q = marks.select("doc", "ord", "text", F.col("m.at").alias("at"), (F.col("m.at") + F.length("m.mark")).alias("begin"))
    q = q.withColumn("next_at", F.lead("at").over(w))
    # One character before is kept, so that a name is looked for at the start of lines only.
    rest = F.substring("text", F.col("begin"), F.length("text"))
    q = q.withColumn("rest", rest)
    first = lambda p: F.when(F.col("rest").rlike(p), F.length(F.get(F.split("rest", p, 2), F.lit(0))) - 1 + F.col("begin"))
    q = q.withColumns({"own": first(ANSWER), "named": first(SPEAKER), "speaker": F.trim(F.regexp_extract("rest", SPEAKER, 1))})
    q = q.withColumn("own_end", F.col("own") + F.length(F.regexp_extract("rest", ANSWER, 0)))
    q = q.join(speaker_counts(d).select("doc", "speaker", F.lit(True).alias("_often")), ["doc", "speaker"], "left")
    between = F.substring("text", F.col("begin") + 1, F.col("named") - F.col("begin"))
    good = (F.col("speaker") != "") & ~F.lower("speaker").startswith("http") & (F.col("speaker").rlike("^(?:A|Ａ|答)") | between.rlike("[?？]") | F.col("_often").isNotNull())
    q = q.where(F.col("named").isNull() | good)
    q = q.withColumn("stop", F.coalesce("own", "named"))
    q = q.withColumn("stop", F.when(F.col("next_at").isNull() | (F.col("next_at") >= F.coalesce("stop", F.length("text"))), F.col("stop")))
    strip = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    cut = lambda a, z: strip(F.substring("text", (a + 1).cast("int"), (z - a).cast("int")))
    here = q.where("stop is not null").select("doc", F.col("ord").alias("start"), (F.col("ord") + 1).alias("end"), cut(F.col("begin"), F.col("stop")).alias("q"), cut(F.coalesce("own_end", "named"), F.coalesce("next_at", F.length("text"))).alias("a"))
    # Blocks behind the last question of a block, up to the first question of the next one that has any.
    firsts = marks.groupBy("doc", "ord").agg(F.min("m.at").alias("cut"))
    o = Window.partitionBy("doc").orderBy("ord")
    owned = d.join(firsts, ["doc", "ord"], "left").withColumn("owner", F.last(F.when(F.col("cut").isNotNull(), F.col("ord")), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)))
    owned = owned.where("owner is not null").withColumn("nth", F.row_number().over(Window.partitionBy("doc", "owner").orderBy("ord")))
    part = strip(F.when(F.col("cut").isNotNull(), F.substring("text", F.lit(1), F.col("cut"))).otherwise(F.col("text")))
    reached = F.col("cut").isNull() | (F.col("cut") > 0) | (F.col("nth") == 1)
    tail = owned.groupBy("doc", F.col("owner").alias("ord")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part != "", F.struct("ord", part.alias("text"))))), lambda x: x.text), "\n").alias("a"), F.max(F.when(reached, F.col("ord"))).alias("last"))
    later = q.where("stop is null and next_at is null").join(tail, ["doc", "ord"]).select("doc", F.col("ord").alias("start"), (F.col("last") + 1).alias("end"), cut(F.col("begin"), F.length("text")).alias("q"), "a")
    out = here.unionByName(later).withColumn("a", tx.clean_answer(F.col("a")))
    enough = lambda c: F.length(F.regexp_replace(c, tx.QA_PUNCTUATION, "")) >= 2
    return out.where(enough("q") & enough("a"))


def locate_qa(qa: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``qa(doc, q, a)`` with ``ord``: the first block that holds the question, with the head of the answer in it or the next two."""
    w = Window.partitionBy("doc").orderBy("ord")
    near = blocks.withColumn("near", F.concat_ws("\n", "text", F.lead("text").over(w), F.lead("text", 2).over(w)))
    hit = qa.join(near, "doc").where(F.contains("text", "q") & F.contains("near", F.substring("a", 1, 24)))
    at = hit.groupBy("doc", "q", "a").agg(F.min("ord").alias("ord"))
    return qa.join(at, ["doc", "q", "a"], "left")


def dedupe_qa(rows: DataFrame) -> DataFrame:
    """One row per (doc, question key): extracted before legacy, earliest, longest, widest."""
    w = Window.partitionBy("doc", tx.question_key(F.col("q"))).orderBy(F.col("origin") != "extracted", "start", F.desc(F.length("a")), F.desc(F.col("end") - F.col("start")), "q")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def uncovered(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks that lie in no range [start, end) of their document."""
    covered = ranges.where("start < end").select("doc", F.explode(F.sequence("start", F.col("end") - 1)).alias("ord")).distinct()
    return blocks.join(covered, ["doc", "ord"], "left_anti")


def official_view(qa: DataFrame, pointers: DataFrame, supplements: DataFrame) -> DataFrame:
    """All three kinds together, by kind, document and start, with ``place`` and the count of each kind.

    Each has ``(query_id, doc, start, text)``; a supplement whose fingerprint a Q&A row has is left out.
    """
    own = qa.select("query_id", tx.qa_fingerprint(F.col("text")).alias("f")).distinct()
    s = supplements.withColumn("f", tx.qa_fingerprint(F.col("text"))).join(own, ["query_id", "f"], "left_anti").drop("f")
    kinds = [x.select("query_id", F.lit(k).alias("kind_rank"), F.lit(name).alias("kind"), "doc", "start", "text") for k, (name, x) in enumerate((("qa", qa), ("pointer", pointers), ("supplement", s)))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    w = Window.partitionBy("query_id")
    return every.withColumns({"place": F.row_number().over(w.orderBy("kind_rank", "doc", "start", "text")), "of_kind": F.count("*").over(Window.partitionBy("query_id", "kind"))}).drop("kind_rank")


def build_qa_index(blocks: DataFrame, legacy: DataFrame) -> DataFrame:
    """Extracted and located legacy rows, de-duplicated: ``(doc, q, a, start, end, origin)``."""
    found = extract_qa(blocks).withColumn("origin", F.lit("extracted"))
    old = legacy.where(tx.valid_qa(F.col("q"), F.col("a")))
    old = locate_qa(old, blocks).select("doc", F.col("ord").alias("start"), (F.col("ord") + 1).alias("end"), "q", "a", F.lit("legacy").alias("origin"))
    return dedupe_qa(found.unionByName(old.select(*found.columns)))
