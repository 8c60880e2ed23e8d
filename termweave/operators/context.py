"""Scopes and completion: visible terms are those of a scope and its ancestors; drafts are terms still being typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.operators.join import similarity_join
from termweave.plans.shared import Cut

OPS = ("insert", "delete", "clear", "checkpoint", "undo", "clear_checkpoints", "finalize", "finalize_direct", "discard")


def visible_scopes(scopes: DataFrame, most_depth: int = 1000) -> DataFrame:
    """(context_id, visible_id, depth): each scope with itself and its ancestors, nearest first.

    Ancestors are found by doubling: each round joins the closure so far with itself, so the rounds are the
    logarithm of the depth. A cycle raises once most_depth is passed.
    """
    links = scopes.select("context_id", "parent_id")
    closure = links.select("context_id", F.col("context_id").alias("visible_id"), F.lit(0).alias("depth")).unionByName(links.where("parent_id IS NOT NULL").select("context_id", F.col("parent_id").alias("visible_id"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        now = Cut(closure, "scopes").df
        ends = now.where(F.col("depth") == reach)
        more = ends.join(now.where("depth > 0").select(F.col("context_id").alias("c"), F.col("visible_id").alias("v"), F.col("depth").alias("d")), F.col("visible_id") == F.col("c")).select("context_id", F.col("v").alias("visible_id"), (F.col("depth") + F.col("d")).alias("depth"))
        if not more.limit(1).count():
            return now
        if reach > most_depth:
            raise ValueError("scopes form a cycle or are too deep")
        closure, reach = now.unionByName(more), reach * 2


def remove_scope(scopes: DataFrame, context_id: int) -> DataFrame:
    """Without a scope and its descendants."""
    gone = visible_scopes(scopes).where(F.col("visible_id") == context_id).select("context_id").distinct()
    return scopes.join(gone, "context_id", "left_anti")


def complete(requests: DataFrame, scopes: DataFrame, finalized: DataFrame, drafts: DataFrame, n: int, algorithm: str = "standard", by_draft: bool = True) -> DataFrame:
    """(context_id, query, term, distance, is_draft, contexts, rank) for requests (context_id, query).

    finalized is (term, contexts); drafts is (context_id, term). Drafts are compared by the standard distance; a term that is
    both is a draft. Rank is by (distance, finalized before draft, term), or without by_draft by (distance, term).
    """
    asked = requests.select("context_id", "query").distinct()
    seen = visible_scopes(scopes).select("context_id", "visible_id")
    q = asked.select("query").distinct()
    spread = finalized.select("term", F.explode(F.array_distinct("contexts")).alias("visible_id"))
    done = similarity_join(q, finalized, n, algorithm).join(asked, "query").join(spread, "term").join(seen, ["context_id", "visible_id"])
    done = done.select("context_id", "query", "term", "distance", F.lit(False).alias("is_draft"), "visible_id")
    live = drafts.select(F.col("context_id").alias("visible_id"), "term").where("term <> ''")
    typed = similarity_join(q, live, n).join(asked, "query").join(live, "term").join(seen, ["context_id", "visible_id"])
    typed = typed.select("context_id", "query", "term", "distance", F.lit(True).alias("is_draft"), "visible_id")
    grouped = done.unionByName(typed).groupBy("context_id", "query", "term", "is_draft").agg(F.min("distance").alias("distance"), F.array_sort(F.collect_set("visible_id")).alias("contexts"))
    first = Window.partitionBy("context_id", "query", "term").orderBy(F.desc("is_draft"))
    kept = grouped.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    keys = ["distance", "is_draft", "term"] if by_draft else ["distance", "term"]
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("context_id", "query").orderBy(*keys)))


# What an operation that cannot apply is rejected with.
CONTEXT_NOT_FOUND, NO_CHECKPOINTS, EMPTY_DRAFT, EMPTY_TERM, UNKNOWN_OPERATION = "ContextNotFound", "NoCheckpoints", "EmptyDraft", "EmptyTerm", "UnknownOperation"


def fold_log(log: DataFrame) -> DataFrame:
    """(context_id, draft, marks, finalized, rejected) after the operations (context_id, seq, op, arg), in order of seq.

    Undo cuts the draft to the last checkpoint and takes that away; it brings no deleted characters back. A finalize adds
    the draft to the scope's terms once and clears draft and checkpoints. Operations that cannot apply change nothing and are listed
    in rejected as (seq, op, error). An operation depends on those before it, so the operations of one scope, and only these,
    come together in one row.
    """
    texts, numbers = "array<string>", "array<int>"
    state = F.struct(
        F.lit("").alias("draft"),
        F.array().cast(numbers).alias("marks"),
        F.array().cast(texts).alias("done"),
        F.array().cast("array<struct<seq:bigint,op:string,error:string>>").alias("rejected"),
    )

    def step(s, e):
        op, arg, draft, marks = e["op"], F.coalesce(e["arg"], F.lit("")), s["draft"], s["marks"]
        can_undo, has = F.size(marks) > 0, F.length(draft) > 0
        new_draft = (
            F.when(op == "insert", F.concat(draft, arg))
            .when((op == "delete") & has, F.substring(draft, F.lit(1), F.length(draft) - 1))
            .when(op.isin("clear", "discard") | ((op == "finalize") & has), F.lit(""))
            .when((op == "undo") & can_undo, F.substring(draft, F.lit(1), F.try_element_at(marks, F.lit(-1))))
            .otherwise(draft)
        )
        new_marks = (
            F.when(op == "checkpoint", F.concat(marks, F.array(F.length(draft))))
            .when((op == "undo") & can_undo, F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0))))
            .when(op.isin("clear_checkpoints", "discard") | ((op == "finalize") & has), F.array().cast(numbers))
            .otherwise(marks)
        )
        term = F.when((op == "finalize") & has, draft).when((op == "finalize_direct") & (arg != ""), arg)
        error = (
            F.when((op == "undo") & ~can_undo, F.lit(NO_CHECKPOINTS))
            .when((op == "finalize") & ~has, F.lit(EMPTY_DRAFT))
            .when((op == "finalize_direct") & (arg == ""), F.lit(EMPTY_TERM))
            .when(op.isNull() | ~op.isin(*OPS), F.lit(UNKNOWN_OPERATION))
        )
        rejected = F.concat(s["rejected"], F.array(F.struct(e["seq"].cast("long").alias("seq"), op.alias("op"), error.alias("error"))))
        return F.struct(new_draft.alias("draft"), new_marks.alias("marks"), F.when(term.isNotNull(), F.array_union(s["done"], F.array(term))).otherwise(s["done"]).alias("done"), F.when(error.isNotNull(), rejected).otherwise(s["rejected"]).alias("rejected"))

    ops = log.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "arg"))).alias("ops"))
    end = ops.select("context_id", F.aggregate("ops", state, step).alias("s"))
    return end.select("context_id", F.col("s.draft").alias("draft"), F.col("s.marks").alias("marks"), F.array_sort("s.done").alias("finalized"), F.col("s.rejected").alias("rejected"))


def fold_drafts(log: DataFrame) -> DataFrame:
    """(context_id, draft, checkpoints, finalized, errors): ``fold_log`` with checkpoints and rejections counted."""
    return fold_log(log).select("context_id", "draft", F.size("marks").alias("checkpoints"), "finalized", F.size("rejected").alias("errors"))


def rejected(log: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(context_id, seq, op, error) of the operations that were rejected; with scopes also those of scopes that are not there."""
    known, unknown = log, None
    if scopes is not None:
        ids = scopes.select(F.col("context_id").alias("__c")).distinct()
        known = log.join(ids, F.col("context_id") == F.col("__c"), "left_semi")
        unknown = log.join(ids, F.col("context_id") == F.col("__c"), "left_anti").select("context_id", F.col("seq").cast("long").alias("seq"), "op", F.lit(CONTEXT_NOT_FOUND).alias("error"))
    out = fold_log(known).select("context_id", F.explode("rejected").alias("r")).select("context_id", "r.*")
    return out if unknown is None else out.unionByName(unknown)


def is_descendant(scopes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(context_id, ancestor_id, is_descendant) of pairs; a scope is no descendant of itself."""
    above = visible_scopes(scopes).where("depth > 0").select(F.col("context_id").alias("__c"), F.col("visible_id").alias("__v"))
    joined = pairs.join(above, (F.col("context_id") == F.col("__c")) & (F.col("ancestor_id") == F.col("__v")), "left")
    return joined.select("context_id", "ancestor_id", F.col("__c").isNotNull().alias("is_descendant"))


def depth(scopes: DataFrame) -> DataFrame:
    """(context_id, depth): how many ancestors a scope has."""
    return visible_scopes(scopes).groupBy("context_id").agg(F.max("depth").alias("depth"))


def broken_scopes(scopes: DataFrame) -> DataFrame:
    """(context_id, parent_id) of scopes whose parent is not there."""
    ids = scopes.select(F.col("context_id").alias("__c")).distinct()
    return scopes.where("parent_id IS NOT NULL").join(ids, F.col("parent_id") == F.col("__c"), "left_anti").select("context_id", "parent_id")


class CompletionEngine:
    """Scopes, finalized terms (term, contexts) and an edit log, bound together; every call gives a table or a new engine.

    The log may be appended to by batch (``apply``). Terms that it finalizes belong to their scope from then on; drafts are what it leaves.
    """

    def __init__(self, scopes: DataFrame, finalized: DataFrame | None = None, log: DataFrame | None = None, algorithm: str = "standard"):
        spark = scopes.sparkSession
        self.scopes, self.algorithm = scopes.select("context_id", "parent_id"), algorithm
        self.finalized = finalized if finalized is not None else spark.createDataFrame([], "term string, contexts array<bigint>")
        self.log = log if log is not None else spark.createDataFrame([], "context_id long, seq long, op string, arg string")

    def with_scopes(self, new: DataFrame) -> CompletionEngine:
        more = self.scopes.unionByName(new.select("context_id", "parent_id"))
        if broken_scopes(more).limit(1).count():
            raise ValueError(CONTEXT_NOT_FOUND)
        return CompletionEngine(more, self.finalized, self.log, self.algorithm)

    def without_scope(self, context_id: int) -> CompletionEngine:
        return CompletionEngine(remove_scope(self.scopes, context_id), self.finalized, self.log, self.algorithm)

    def apply(self, ops: DataFrame) -> CompletionEngine:
        """With more operations; their seq must lie above those of the log."""
        return CompletionEngine(self.scopes, self.finalized, self.log.unionByName(ops.select("context_id", F.col("seq").cast("long").alias("seq"), "op", "arg")), self.algorithm)

    def _known(self) -> DataFrame:
        ids = self.scopes.select(F.col("context_id").alias("__c")).distinct()
        return self.log.join(ids, F.col("context_id") == F.col("__c"), "left_semi")

    def drafts(self) -> DataFrame:
        """(context_id, term)"""
        return fold_drafts(self._known()).where("draft <> ''").select("context_id", F.col("draft").alias("term"))

    def rejected(self) -> DataFrame:
        return rejected(self.log, self.scopes)

    def terms(self) -> DataFrame:
        """(term, contexts): all finalized terms with their scopes."""
        typed = fold_drafts(self._known()).select(F.explode("finalized").alias("term"), "context_id")
        given = self.finalized.select("term", F.explode("contexts").alias("context_id"))
        return given.unionByName(typed).groupBy("term").agg(F.array_sort(F.collect_set("context_id")).alias("contexts"))

    def has_term(self, terms: DataFrame) -> DataFrame:
        """(term, found) of each distinct term."""
        return self.term_contexts(terms).select("term", (F.size("contexts") > 0).alias("found"))

    def term_contexts(self, terms: DataFrame) -> DataFrame:
        """(term, contexts) of each distinct term; no scopes where it is unknown."""
        known = self.terms().select(F.col("term").alias("__t"), "contexts")
        return terms.select("term").distinct().join(known, F.col("term") == F.col("__t"), "left").select("term", F.coalesce("contexts", F.array().cast("array<bigint>")).alias("contexts"))

    def complete(self, requests: DataFrame, n: int) -> DataFrame:
        return complete(requests, self.scopes, self.terms(), self.drafts(), n, self.algorithm)
