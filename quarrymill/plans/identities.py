"""Identity, acceptance and report queries; documents are tracks, labels their reviews, sources the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import identity as I
from ..operators import selection as S
from ..operators import sequences as Q
from ..operators.teams import running_before
from ..sources.tables import last_wins, place, table
from .registry import query

_EVID = """ev AS (SELECT d.doc_id, d.source AS fixture, CASE WHEN d.doc_id % 3 = 0 THEN 'seed' ELSE 'evaluation' END AS split, CASE l.quality WHEN 1 THEN 'team_a' WHEN 0 THEN 'other' END AS reviewed FROM documents d LEFT JOIN labels l USING (doc_id)),
pr AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'unknown' WHEN n_chars % 3 = 1 THEN 'team_a' ELSE 'other' END AS predicted, (n_chars % 100) / 100.0::DOUBLE AS confidence FROM documents WHERE lang <> 'es')"""


def _evidence(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    reviewed = F.when(F.col("quality") == 1, "team_a").when(F.col("quality") == 0, "other")
    split = F.when(F.col("doc_id") % 3 == 0, "seed").otherwise("evaluation")
    ev = d.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("fixture"), split.alias("split"), reviewed.alias("reviewed"))
    k = F.col("n_chars") % 3
    guess = F.when(k == 0, "unknown").when(k == 1, "team_a").otherwise("other")
    return ev, d.where("lang <> 'es'").select("doc_id", guess.alias("predicted"), (F.col("n_chars") % 100 / 100.0).alias("confidence"))


_DECIDE = f"""WITH {_EVID}, de AS (SELECT ev.doc_id, CASE WHEN split = 'seed' AND reviewed IS NOT NULL THEN reviewed ELSE coalesce(predicted, 'unknown') END AS label,
CASE WHEN split = 'seed' AND reviewed IS NOT NULL THEN 'human_seed' WHEN predicted IS NOT NULL THEN 'model' ELSE 'missing' END AS source,
CASE WHEN split = 'seed' AND reviewed IS NOT NULL THEN 'accepted' WHEN predicted <> 'unknown' THEN 'agent_proposal' ELSE 'needs_review' END AS status FROM ev LEFT JOIN pr USING (doc_id))"""


@query(_DECIDE + " SELECT doc_id, label, source, status FROM de")
def identity_decisions(spark, sf_dir):
    ev, pr = _evidence(spark, sf_dir)
    return I.decide(ev, pr, "doc_id", "split", "reviewed", "predicted").select("doc_id", "label", "source", "status")


@query(_DECIDE + """, t AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN user_id END AS doc_id FROM events)
SELECT t.event_id, coalesce(label, 'unknown') AS label, coalesce(source, 'untracked') AS source, coalesce(status, 'needs_review') AS status FROM t LEFT JOIN de USING (doc_id)""")
def detection_identities(spark, sf_dir):
    ev, pr = _evidence(spark, sf_dir)
    de = I.decide(ev, pr, "doc_id", "split", "reviewed", "predicted")
    t = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("user_id")).alias("doc_id"))
    return I.identify_detections(t, de, ["doc_id"]).select("event_id", "label", "source", "status")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'counterpress' WHEN value >= 80 THEN 'high_press_candidate' ELSE 'individual_pressure' END AS label FROM events""")
def pressure_event_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", I.pressure_label(F.col("event_type") == "click", F.col("value")).alias("label"))


@query("""WITH r AS (SELECT c_custkey, list_filter([CASE WHEN NOT c_custkey % 4 > 0 THEN 'possession' END, CASE WHEN NOT c_custkey % 5 > 0 THEN 'attack direction' END, CASE WHEN NOT c_nationkey >= 7 THEN 'visible players' END,
 CASE WHEN NOT (c_custkey % 100) / 100.0 >= 0.65 THEN 'model confidence' END], lambda x: x IS NOT NULL) AS reasons FROM customer)
SELECT c_custkey, CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'abstain' END AS decision, array_to_string(reasons, '; ') AS reasons FROM r""")
def acceptance_reasons(spark, sf_dir):
    k = F.col("c_custkey")
    reasons = I.acceptance(k % 4 > 0, k % 5 > 0, F.col("c_nationkey"), k % 100 / 100.0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.size(reasons) == 0, "accepted").otherwise("abstain").alias("decision"), F.array_join(reasons, "; ").alias("reasons"))


@query("""WITH t AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linestatus)) AS teams FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l.l_linestatus, CASE WHEN len(teams) = 2 THEN CASE WHEN teams[1] = l.l_linestatus THEN teams[2] ELSE teams[1] END END AS opponent, count(*) AS n FROM lineitem l JOIN t USING (l_orderkey) GROUP BY ALL""")
def opponents(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    teams = li.groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("teams"))
    return li.join(teams, "l_orderkey").groupBy("l_orderkey", "l_linestatus", I.only_other(F.col("teams"), F.col("l_linestatus")).alias("opponent")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def tracks_in_all(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return I.in_all([e.where(F.col("event_type") == t) for t in ("view", "click", "error")], ["user_id"])


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'ignore' WHEN user_id % 2 = 0 THEN 'team_a' ELSE 'team_b' END AS team FROM events""")
def fail_closed_teams(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit("raw").alias("team"))
    known = e.where("user_id % 3 > 0").select("user_id", F.when(F.col("user_id") % 2 == 0, "team_a").otherwise("team_b").alias("team")).distinct()
    return I.assign_or_ignore(e, known, ["user_id"], "team").select("event_id", "team")


@query(f"""WITH {_EVID}, j AS (SELECT fixture, reviewed, predicted, confidence FROM ev JOIN pr USING (doc_id) WHERE reviewed IS NOT NULL), r AS (SELECT fixture, reviewed, avg((reviewed = predicted)::INT) AS r FROM j GROUP BY ALL), b AS (SELECT fixture, avg(r) AS ba FROM r GROUP BY 1)
SELECT fixture, count(*) AS rows, round(avg((reviewed = predicted)::INT), 6) AS accuracy, round(avg((confidence >= 0.5)::INT), 6) AS accepted, round(coalesce(count(*) FILTER (confidence >= 0.5 AND reviewed = predicted) / nullif(count(*) FILTER (confidence >= 0.5), 0), 0), 6) AS accepted_accuracy,
round(any_value(ba), 6) AS balanced_accuracy FROM j JOIN b USING (fixture) GROUP BY fixture""")
def fold_report(spark, sf_dir):
    ev, pr = _evidence(spark, sf_dir)
    r = I.fold_report(ev.where("reviewed is not null").join(pr, "doc_id"), "fixture", "reviewed", "predicted", "confidence", 0.5)
    return r.withColumns({c: F.round(c, 6) for c in ("accuracy", "accepted", "accepted_accuracy", "balanced_accuracy")})


@query("""WITH p AS (SELECT user_id, value / 100 AS a, 1 - value / 100 AS b FROM events), m AS (SELECT user_id, avg(a) AS a, avg(b) AS b FROM p GROUP BY 1), f AS (SELECT user_id, 'a' AS cls, a AS p, a, b FROM m UNION ALL SELECT user_id, 'b', b, a, b FROM m)
SELECT user_id, cls, round(p, 6) AS p, CASE WHEN a >= b THEN 'a' ELSE 'b' END AS dominant FROM f""")
def mean_probabilities(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", place().alias("place"), F.create_map(F.lit("a"), F.col("value") / 100, F.lit("b"), 1 - F.col("value") / 100).alias("probabilities"))
    return I.mean_probabilities(e, ["user_id"], "probabilities", "place").withColumn("p", rounded("p", 6))


@query()
def labelled_metrics(spark, sf_dir):
    """Lines of an order against those of the next one as truth and prediction: tp, fp, fn, precision, recall, F1 over all frames."""
    from ..operators.aggregates import detection_scores

    li = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    truth = li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("qa"))
    guess = li.select((F.col("l_orderkey") - 1).alias("frame"), F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("qb"))
    pairs = truth.join(guess, "frame").withColumn("score", 1 - F.abs(F.col("qa") - F.col("qb")) / 50)
    counts = I.labelled_counts(truth, guess, Q.greedy_match(pairs, ["frame"], "a", "b", "score", 0.8), ["frame"])
    return detection_scores(counts.withColumn("set", F.lit("all")), ["set"])


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48 ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 40""")
def longest_phases(spark, sf_dir):
    """Rows of one kind that last long enough, longest first."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select("l_orderkey", "l_linenumber", "l_quantity")
    return S.top(li, [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber")], 40)


@query("""SELECT l_returnflag, l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY a DESC, t DESC, n DESC, l_orderkey)::INT AS place FROM (SELECT l_returnflag, l_orderkey, bool_or(l_linestatus = 'F') AS a, bool_or(l_tax > 0.04) AS t, count(*) AS n FROM lineitem GROUP BY ALL)""")
def ordered_chains(spark, sf_dir):
    """Chains by several criteria, falling, with the original order last."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.bool_or(F.col("l_linestatus") == "F").alias("a"), F.bool_or(F.col("l_tax") > 0.04).alias("t"), F.count("*").alias("n"))
    g = running_before(g.withColumn("one", F.lit(1)), ["l_returnflag"], [F.desc("a"), F.desc("t"), F.desc("n"), F.asc("l_orderkey")], "one", "before")
    return g.select("l_returnflag", "l_orderkey", (F.col("before") + 1).cast("int").alias("place"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS v, 1 AS shard FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders WHERE o_orderkey % 2 = 1) SELECT k, arg_max(v, (shard, v)) AS v FROM s GROUP BY k""")
def merged_shards(spark, sf_dir):
    """Shards of results put together; of one key the last shard's last row wins."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), (1 + F.col("o_orderkey") % 2).alias("shard"))
    return last_wins(o.where("shard = 1").union(o.where("shard = 2")), ["k"], [F.col("shard"), F.col("v")]).select("k", "v")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND c_acctbal >= 0""")
def kept_legacy(spark, sf_dir):
    """Rows that are neither removed nor there already: two anti-joins."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    have = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    removed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return c.join(removed, "c_custkey", "left_anti").join(have, "c_custkey", "left_anti")


@query("""SELECT l.doc_id, quality, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents USING (doc_id) WHERE source <> 'src0'""")
def reviewed_predictions(spark, sf_dir):
    """Reviewed rows with their predictions, without a split that is left out."""
    d = table(spark, sf_dir, "documents").where("source <> 'src0'").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("predicted"))
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")


@query("""SELECT event_id, CASE WHEN value / 100 >= 0.7 AND event_type <> 'error' THEN event_type END AS label FROM events WHERE value / 100 >= 0.7 AND event_type <> 'error'""")
def confident_labels(spark, sf_dir):
    """Weak labels that don't abstain and are confident."""
    return table(spark, sf_dir, "events").where((F.col("value") / 100 >= 0.7) & (F.col("event_type") != "error")).select("event_id", F.col("event_type").alias("label"))
