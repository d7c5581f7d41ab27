"""Linking named entities to a catalog: blocks, fuzzy scores, guards, manual decisions, lookups, evidence states.

Rows to link have `id, make, model, year`; catalog rows `cand_id, make, model, year, verified`. Blocks are equal
make keys and years, so every pair comes from an equi-join, and decisions are aggregates, not windows over pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscore.functions import text as T
from cohortscore.functions.similarity import with_similarity
from cohortscore.operators.guards import checked_join

#: Statuses that link an entity. Fixed values.
ACCEPTED = ("auto_accepted", "manual_accepted")
CONFIRMED = ACCEPTED + ("query_failed", "unverified_zero_result")


def _keyed(rows: DataFrame, trims: Sequence[str], prefix: str = "") -> DataFrame:
    model = F.col("model")
    keys = {"make_key": T.comparison_make(F.col("make")), f"{prefix}key": T.comparison_model(model), f"{prefix}root": T.root_name(model, trims)}
    return rows.withColumns(keys)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that are null or occur more than once, with their counts."""
    missing = " OR ".join(f"{k} IS NULL" for k in keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(f"n > 1 OR {missing}")


def unverified(catalog: DataFrame) -> DataFrame:
    """Catalog rows that lack the flag of an official source; null is no flag."""
    return catalog.filter(~F.coalesce(F.col("verified"), F.lit(False)))


def enforce(violations: DataFrame, what: str) -> None:
    """Fail if there is any violation."""
    if not violations.isEmpty():
        raise ValueError(what)


def enforce_all(*guards: tuple[DataFrame, str]) -> None:
    """Fail with the first broken guard; all are looked at in one job."""
    broken = [violations.select(F.lit(i).alias("i")).limit(1) for i, (violations, _) in enumerate(guards)]
    first = reduce(DataFrame.unionAll, broken).agg(F.min("i")).first()[0]
    if first is not None:
        raise ValueError(guards[first][1])


def _checked(rows: DataFrame, catalog: DataFrame, auto: int, manual: int, require_verified: bool) -> None:
    if not 0 <= manual <= auto <= 100:
        raise ValueError("thresholds are 0 <= manual <= auto <= 100")
    guards = [(duplicate_keys(rows, "id"), "an id is null or occurs twice"), (duplicate_keys(catalog, "cand_id"), "a candidate id is null or occurs twice")]
    enforce_all(*guards, *([(unverified(catalog), "a candidate is not verified")] if require_verified else []))


def _decided(left: DataFrame, catalog: DataFrame, trims: Sequence[str], auto: int, manual: int, carried: Sequence[str] = ()) -> DataFrame:
    """`left` with the decision on its names: the best candidate, its root and what else is `carried` of it, scores and status."""
    name = ["make_key", "year", "key", "root"]
    names = left.select(*name).distinct()
    more = [F.min_by(F.struct(*carried), "cand_id").alias("carried")] if carried else []
    right = _keyed(catalog, trims, "c_").groupBy("make_key", "year", "c_key", "c_root").agg(F.count("*").alias("of"), F.min("cand_id").alias("cand_id"), *more)
    pairs = with_similarity(names.join(right, ["make_key", "year"]), "key", "c_key")
    best = F.struct((F.col("key") != F.col("c_key")).alias("other"), F.col("c_key"), F.col("cand_id"), F.col("c_root"), *(["carried"] if carried else []))
    levels = pairs.groupBy(*name, "score").agg(F.sum("of").alias("n"), F.sum(F.when(F.col("key") == F.col("c_key"), F.col("of")).otherwise(0)).alias("exact"), F.min(best).alias("b"))
    order = F.struct("b.other", -F.col("score"), "b.c_key", "b.cand_id", "b.c_root", "score", "n", *(["b.carried"] if carried else []))
    chosen = levels.groupBy(*name).agg(F.min(order).alias("o"), F.sum("exact").alias("n_exact"))
    chosen = chosen.select(*name, "n_exact", F.col("o.cand_id"), F.col("o.score"), F.col("o.n").alias("n_best"), F.col("o.c_root"), F.col("o.c_key").alias("cand_key"), (~F.col("o.other")).alias("is_exact"), *[F.col(f"o.carried.{c}").alias(f"cand_{c}") for c in carried])
    root_equal = (F.col("root") != "") & (F.col("root") == F.col("c_root"))
    ambiguous = (F.col("n_exact") > 1) | (~F.col("is_exact") & (F.col("n_best") > 1))
    sure = (F.col("score") >= auto) & (root_equal | F.col("is_exact") & (F.col("n_exact") == 1)) & ~ambiguous
    status = F.when(T.digits_of(F.col("root")) != T.digits_of(F.col("c_root")), "rejected").when(sure, "auto_accepted").when(F.col("score") >= manual, "manual_review").otherwise("rejected")
    decided = chosen.withColumns({"status": status, "root_equal": root_equal, "advice": T.review_advice(F.col("score"), F.col("root"), F.col("c_root"), manual)})
    return left.join(decided, name, "left").na.fill({"status": "no_candidate"})


def match_entities(rows: DataFrame, catalog: DataFrame, trims: Sequence[str], auto: int = 90, manual: int = 75, require_verified: bool = True) -> DataFrame:
    """`id, cand_id, score, status, root_equal, n_exact, n_best, cand_key, advice` for every row.

    The best candidate of a block has the exact key, then the highest score, then the smallest key and id. Other
    numbers in the names reject it. From `auto` on it is accepted if the root names agree or the exact name is
    unique, and no other candidate is as good; from `manual` on it goes to review. Without a block: no_candidate.
    Names are scored once per block and distinct pair, whatever the number of rows. Ids are unique and not null, and
    every candidate has the flag of an official source, or the call fails; `require_verified` waives the flag.
    """
    _checked(rows, catalog, auto, manual, require_verified)
    left = _keyed(rows, trims).select("id", "make_key", "year", "key", "root")
    return _decided(left, catalog, trims, auto, manual).select("id", "cand_id", "score", "status", "root_equal", "n_exact", "n_best", "cand_key", "advice")


def match_table(rows: DataFrame, catalog: DataFrame, trims: Sequence[str], auto: int = 90, manual: int = 75, require_verified: bool = True) -> DataFrame:
    """The decisions of `match_entities` as the table that reviewers and later stages read, one row per entity.

    `id, make, model, year` are the entity's, `cand_id, cand_make, cand_model, cand_verified, cand_source` its best
    candidate's (`source` of the catalog; null if that has none), then `score, status, root, cand_root, root_equal,
    advice, decision` (null until someone decides) and `audit_required` (all that is not accepted at once). Without a
    candidate the `cand_` columns and the score are null, the roots are not equal, and the advice is to reject. What is
    shown of a candidate travels with its id through the aggregates, so the catalog is not joined a second time.
    """
    _checked(rows, catalog, auto, manual, require_verified)
    left = _keyed(rows, trims).select("id", "make", "model", "make_key", "year", "key", "root")
    listed = catalog.withColumn("verified", F.coalesce("verified", F.lit(False)))
    listed = listed if "source" in catalog.columns else listed.withColumn("source", F.lit(None).cast("string"))
    out = _decided(left, listed, trims, auto, manual, ("make", "model", "verified", "source"))
    return out.select(
        "id", "make", "model", "year", "cand_id", "cand_make", "cand_model", "score", "status", "root", F.col("c_root").alias("cand_root"),
        F.coalesce("root_equal", F.lit(False)).alias("root_equal"), F.coalesce("advice", F.lit(T.NO_CANDIDATE)).alias("advice"),
        F.lit(None).cast("string").alias("decision"), (F.col("status") != "auto_accepted").alias("audit_required"), "cand_verified", "cand_source",
    )


def match_summary(matches: DataFrame, alarm: float = 0.4) -> DataFrame:
    """One row: counts by outcome, the share that was not linked, and whether it is above the alarm."""
    counts = matches.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(*ACCEPTED)).alias("accepted"), *[F.count_if(F.col("status") == s).alias(s) for s in ("manual_review", "rejected", "no_candidate")])
    loss = F.when(F.col("n") > 0, 1 - F.col("accepted") / F.col("n"))
    return counts.withColumns({"loss_rate": F.round(loss, 6), "alarm": F.coalesce(loss > alarm, F.lit(False))})


def decision_flag(text: Column) -> Column:
    """A reviewer's word as true, false or null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("accept", "accepted", "approve", "approved", "aceptar", "aceptado", "si", "sí", "yes", "true", "1"), True).when(word.isin("reject", "rejected", "rechazar", "rechazado", "no", "false", "0"), False)


def apply_decisions(matches: DataFrame, decisions: DataFrame, require_root: bool = True) -> DataFrame:
    """Settle rows under review by `id, decision`. An acceptance needs equal root names unless that is waived."""
    enforce(duplicate_keys(decisions, "id"), "more than one decision for an id")
    flag = decision_flag(F.col("decision"))
    allowed = F.col("root_equal") if require_root else F.lit(True)
    status = F.when((F.col("status") == "manual_review") & flag & allowed, "manual_accepted").when((F.col("status") == "manual_review") & ~flag, "manual_rejected").otherwise(F.col("status"))
    return matches.join(decisions.select("id", "decision"), "id", "left").withColumn("status", status).drop("decision")


def equivalence_violations(records: DataFrame, rows: DataFrame, catalog: DataFrame, today: str) -> DataFrame:
    """`id, rule` for every rule that a documented equivalence breaks."""
    left = rows.select("id", F.lit(True).alias("known"), T.comparison_make(F.col("make")).alias("make_key"), "year", T.digits_of(F.col("model")).alias("digits"))
    right = catalog.select("cand_id", "verified", T.comparison_make(F.col("make")).alias("c_make"), F.col("year").alias("c_year"), T.digits_of(F.col("model")).alias("c_digits"))
    joined = records.join(left, "id", "left").join(right, "cand_id", "left")
    empty = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("id", "cand_id", "reviewer", "reviewed_at", "evidence_url", "evidence_sha256", "justification")]
    blank = empty[0]
    for e in empty[1:]:
        blank = blank | e
    reviewed = F.try_to_timestamp(F.col("reviewed_at"), F.lit("yyyy-MM-dd")).cast("date")
    rules = {
        "blank_field": blank,
        "bad_sha256": ~F.col("evidence_sha256").rlike("^[0-9a-f]{64}$"),
        "not_https": ~F.col("evidence_url").startswith("https://"),
        "bad_date": reviewed.isNull() | (reviewed > F.lit(today).cast("date")),
        "unknown_entity": F.col("known").isNull(),
        "unverified_candidate": ~F.coalesce(F.col("verified"), F.lit(False)),
        "other_make_or_year": ~F.coalesce((F.col("make_key") == F.col("c_make")) & (F.col("year") == F.col("c_year")), F.lit(False)),
        "other_digits": ~F.coalesce(F.col("digits") == F.col("c_digits"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), name) for name, test in rules.items()]))
    return joined.select("id", F.explode(broken).alias("rule"))


def apply_equivalences(matches: DataFrame, records: DataFrame, rows: DataFrame, catalog: DataFrame, today: str) -> DataFrame:
    """Link rows to the candidates of documented equivalences; any broken rule fails the whole call."""
    enforce(duplicate_keys(records, "id"), "more than one equivalence for an id")
    enforce(equivalence_violations(records, rows, catalog, today), "an equivalence breaks a rule")
    new = records.select("id", F.col("cand_id").alias("_cand"), "reviewer", "reviewed_at", "evidence_url", "evidence_sha256", "justification")
    out = matches.join(new, "id", "left")
    linked = F.col("_cand").isNotNull()
    return out.withColumns({"cand_id": F.when(linked, F.col("_cand")).otherwise(F.col("cand_id")), "status": F.when(linked, "manual_accepted").otherwise(F.col("status"))}).drop("_cand")


def two_stage_lookup(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """`make, model, year, stage, cand_id, n` for distinct requests: the literal name, else the normalised one.

    Literal names ignore the case of A-Z and outer spaces. Only where no literal name exists the keys count, so an
    ambiguous literal name stays unanswered. `cand_id` is null unless exactly one entity answers.
    """
    plain = lambda c: F.translate(F.trim(c), T.UPPER, T.UPPER.lower())
    asked = requests.select("make", "model", "year").distinct()
    asked = asked.withColumns({"m": plain(F.col("make")), "l": plain(F.col("model")), "mk": T.comparison_make(F.col("make")), "lk": T.comparison_model(F.col("model"))})
    literal = entities.groupBy(plain(F.col("make")).alias("m"), plain(F.col("model")).alias("l"), "year").agg(F.count("*").alias("n1"), F.min("cand_id").alias("c1"))
    keyed = entities.groupBy(T.comparison_make(F.col("make")).alias("mk"), T.comparison_model(F.col("model")).alias("lk"), "year").agg(F.count("*").alias("n2"), F.min("cand_id").alias("c2"))
    found = asked.join(literal, ["m", "l", "year"], "left").join(keyed, ["mk", "lk", "year"], "left")
    n = F.coalesce("n1", "n2", F.lit(0)).cast("long")
    return found.select("make", "model", "year", F.when(F.col("n1").isNotNull(), "literal").when(F.col("n2").isNotNull(), "normalised").alias("stage"), F.when(n == 1, F.coalesce("c1", "c2")).alias("cand_id"), n.alias("n"))


def resolve_inventory(variants: DataFrame, catalog: DataFrame, manual: int = 75) -> DataFrame:
    """`make, model, year, status, cand_id, n_candidates` for each distinct name of the variants.

    One literal name links, else one normalised name; several are ambiguous; with none, candidates of the block from
    `manual` points on are counted as suggestions. Suggestions are counted, not gathered, so blocks may be large.
    """
    literal = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    names = variants.select("make", "model", "year").distinct().withColumns({"make_key": T.comparison_make(F.col("make")), "key": T.comparison_model(F.col("model"))})
    right = catalog.select("cand_id", T.comparison_make(F.col("make")).alias("make_key"), F.col("make").alias("c_make"), F.col("model").alias("c_model"), "year", T.comparison_model(F.col("model")).alias("c_key"))
    pairs = with_similarity(names.join(right, ["make_key", "year"]), "key", "c_key")
    exact = (literal(F.col("model")) == literal(F.col("c_model"))) & (literal(F.col("make")) == literal(F.col("c_make")))
    same = F.col("key") == F.col("c_key")
    counted = pairs.groupBy("make", "model", "year").agg(
        F.count_if(exact).alias("e"), F.min(F.when(exact, F.col("cand_id"))).alias("e_id"),
        F.count_if(same).alias("k"), F.min(F.when(same, F.col("cand_id"))).alias("k_id"),
        F.count_if(F.col("score") >= manual).alias("s"), F.count("*").alias("pool"),
    )
    out = names.select("make", "model", "year").join(counted, ["make", "model", "year"], "left")
    n = F.when(F.col("e") > 0, F.col("e")).otherwise(F.col("k"))
    status = F.when(F.col("pool").isNull(), "no_same_make_year").when(F.col("e") == 1, "exact_name").when(n > 1, "ambiguous_name").when(n == 1, "normalized_name").when(F.col("s") > 0, "manual_review").otherwise("no_model_match")
    count = F.coalesce(F.when(n > 0, n).otherwise(F.col("s")), F.lit(0)).cast("long")
    return out.select("make", "model", "year", status.alias("status"), F.when(n == 1, F.when(F.col("e") == 1, F.col("e_id")).otherwise(F.col("k_id"))).alias("cand_id"), count.alias("n_candidates"))


def evidence_states(rows: DataFrame, matches: DataFrame, queries: DataFrame, gold: DataFrame, mature: Column) -> DataFrame:
    """Why each of `rows` (`id`, and what `mature` reads) is or is not in the final table (`id, n_in_window`).

    `matches` has `id, cand_id, status`, `queries` `cand_id, query_status`. A response counts only for a confirmed
    identity; the later of several reasons wins: identity, window, response, inclusion. An id of `rows`, `matches` or
    `gold`, or a `cand_id` of `queries`, that comes twice fails the pass.
    """
    joined = rows.withColumn("mature", mature)
    joined = checked_join(joined, matches.select("id", "cand_id", "status"), ["id"], unique="both")
    joined = checked_join(joined, queries, ["cand_id"])
    joined = checked_join(joined, gold.select("id", "n_in_window", F.lit(True).alias("_g")), ["id"])
    status = F.coalesce("status", F.lit("not_in_matching_scope"))
    query = F.when(status.isin("query_failed", "unverified_zero_result"), status).otherwise(F.coalesce("query_status", F.lit("not_recorded")))
    known = status.isin(*CONFIRMED)
    included = F.col("_g").isNotNull()
    reason = F.when(included, "included").when(known & query.isin("not_recorded", "query_failed", "unverified_zero_result"), query).when(known & ~F.col("mature"), "incomplete_window").when(known, "eligible_identity_not_in_gold").when(status.isin("rejected", "manual_rejected", "manual_review", "no_candidate", "not_in_matching_scope"), status).otherwise("unresolved_identity")
    return joined.select(
        "id",
        F.when(known, "confirmed_by_matching").when(status == "manual_review", "requires_review").otherwise("unresolved").alias("identity_status"),
        F.when(known, query).otherwise("not_linked_to_verified_identity").alias("query_status"),
        F.when(F.col("mature"), "complete").otherwise("incomplete").alias("window_status"),
        reason.alias("primary_reason"),
        F.when(~included, "unknown").when(F.col("n_in_window") == 0, "zero_in_window").otherwise("positive_in_window").alias("window_outcome"),
    )


def evidence_contradictions(states: DataFrame) -> DataFrame:
    """Included rows without a confirmed identity, a valid response or a complete window."""
    return states.filter("primary_reason = 'included' AND NOT (identity_status = 'confirmed_by_matching' AND query_status IN ('valid_with_recalls', 'valid_zero_recalls') AND window_status = 'complete')")
