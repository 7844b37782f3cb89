"""Registered queries: one callable per operator, all over the whole given tables."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.models.bundle import Bundle
from alertloom.models.evaluate import average_precision, classification_report, score_quantile
from alertloom.models.forest import ForestSettings
from alertloom.operators import (
    consistency, dashboard, detect, feedback, filters, latency, policy as pol, rolling,
    sampling, template_tree, templates, weaklabel,
)
from alertloom.operators.canonical import canonicalize
from alertloom.operators.explain import findings_documents, rank_features, valid_attributions
from alertloom.operators.features import feature_names, project_features
from alertloom.plans import pipeline, training
from alertloom.schema import DERIVED_FIELDS
from alertloom.session import new_path
from alertloom.sources import fixtures, scans
from alertloom.sources.config import default_feature_map, default_policy

FMAP, POLICY = default_feature_map(), default_policy()
NAMES = feature_names(FMAP)
MAPPED = ["src_ip", "dst_ip", "src_port", "dst_port", "proto", "bytes_sent", "bytes_recv",
          "duration_sec", "rule_level", "severity_ord", "action", "threat_family",
          "service_label", "user", "host", "auth_result", "logon_type"]


def at(seconds: int) -> datetime:
    return datetime.fromtimestamp(fixtures.EPOCH + seconds, timezone.utc)


def _canon(spark, sf, keep=("doc_id",)) -> DataFrame:
    return canonicalize(fixtures.alerts(spark, sf), keep)


def _mapped(platform: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _canon(spark, sf).where(F.col("platform_source") == platform).select(
            "doc_id", *MAPPED)
    return query


def source_detect(spark, sf):
    return (detect.detect_source(detect.with_signals(fixtures.alerts(spark, sf)))
            .groupBy("source", F.col("decoder.name").alias("decoder"))
            .agg(F.count("*").alias("n")))


def policy_source(spark, sf):
    return (detect.policy_source(detect.with_signals(fixtures.alerts(spark, sf)))
            .groupBy("policy_source", F.col("decoder.name").alias("decoder"))
            .agg(F.count("*").alias("n")))


def canonical_summary(spark, sf):
    return (
        _canon(spark, sf).groupBy("source", "platform_source").agg(
            F.count("*").alias("n"), F.avg("severity_ord").alias("severity_mean"),
            *[F.sum(c).alias(f"{c}_sum") for c in
              ("pf_win", "pf_lin", "pf_nw", "pf_osks", "bytes_total", "dst_svc_sensitive",
               "dst_svc_admin", "hour")]))


def derived_flags(spark, sf):
    return _canon(spark, sf).select("doc_id", *DERIVED_FIELDS)


def service_norm(spark, sf):
    return (_canon(spark, sf).groupBy("dst_port", "service_label")
            .agg(F.count("*").alias("n")))


def severity_ord(spark, sf):
    return (_canon(spark, sf).groupBy("platform_source", "rule_level", "severity_ord")
            .agg(F.count("*").alias("n")))


def feature_vector(spark, sf):
    return project_features(_canon(spark, sf), FMAP)


def compact_vector(spark, sf):
    return project_features(_canon(spark, sf), None)


def nonzero_features(spark, sf):
    from alertloom.operators.features import nonzero_map_sql
    return feature_vector(spark, sf).selectExpr(
        "doc_id", f"explode_outer({nonzero_map_sql(NAMES)}) AS (feature, value)").where("feature IS NOT NULL")


def min_level_keyword(spark, sf):
    return filters.passes(fixtures.alerts(spark, sf), 6, "FAILED").selectExpr(
        "doc_id", "cast(rule.level AS BIGINT) AS rule_level")


def time_window_scan(spark, sf):
    return scans.time_window(fixtures.alerts(spark, sf), at(600), at(86400), 6).select("doc_id")


def scan_counters(spark, sf):
    return scans.scan_counters(fixtures.alerts(spark, sf), at(600), at(86400), 6)


def incremental_page(spark, sf):
    done = (at(1234), chr(0x10FFFF))  # after every document of that instant
    return scans.next_page(fixtures.alerts(spark, sf), done, at(86400), 4).select("doc_id")


def cursor_pages(spark, sf):
    return scans.cursor_pages(fixtures.alerts(spark, sf), at(1234), 4).select("doc_id", "page", "place")


def backfill_last_n(spark, sf):
    return scans.backfill(fixtures.alerts(spark, sf), 500, 6).select("doc_id")


def _scored(spark, sf) -> DataFrame:
    """Alerts with the weak score standing in for the model score."""
    return weaklabel.weak_score(fixtures.alerts(spark, sf)).withColumn(
        "score", F.col("weak_score"))


def weak_score(spark, sf):
    return weaklabel.weak_score(fixtures.alerts(spark, sf)).select(
        "doc_id", "weak_points", "weak_score")


def weak_label(spark, sf):
    return (weaklabel.weak_label(weaklabel.weak_score(fixtures.alerts(spark, sf)))
            .select("doc_id", "label", "weight"))


def class_balance(spark, sf):
    return weaklabel.class_balance(
        weaklabel.weak_label(weaklabel.weak_score(fixtures.alerts(spark, sf))))


def _sourced(spark, sf) -> DataFrame:
    return detect.drop_signals(detect.policy_source(detect.with_signals(_scored(spark, sf))))


def policy_threshold_label(spark, sf):
    sources, _ = pol.policy_tables(spark, POLICY)
    return (pol.join_threshold(_sourced(spark, sf), sources, POLICY)
            .selectExpr("doc_id", "policy_source", "threshold",
                        "if(score >= threshold, 'malicious', 'benign') AS label"))


def policy_band(spark, sf):
    sources, bands = pol.policy_tables(spark, POLICY)
    return (pol.join_bands(_sourced(spark, sf), sources, bands, POLICY)
            .select("doc_id", "tag", "policy_action", "recommendation"))


def _override(mode: str):
    def query(spark, sf):
        rows = pipeline.decided_rows(_scored(spark, sf), POLICY, FMAP, mode=mode)
        return rows.select("doc_id", "tag")
    return query


def attribution_budget(spark, sf):
    rows = pipeline.decided_rows(_scored(spark, sf), POLICY, FMAP)
    return rows.groupBy("policy_source", "do_shap").agg(
        F.count("*").alias("n"), F.max(F.col("top_k").cast("bigint")).alias("top_k"))


def _decided(scored: DataFrame, keep=("doc_id", "timestamp")) -> DataFrame:
    rows = pipeline.decided_rows(scored, POLICY, FMAP, keep=keep)
    return fixtures.stand_in_attributions(rows, NAMES)


EMBEDDED = ("id", "rule", "agent", "decoder", "location", "data", "full_log")


def _documents(scored: DataFrame) -> DataFrame:
    rows = _decided(scored, ("doc_id", "timestamp", *EMBEDDED))
    return pipeline.explain_with(rows, POLICY, FMAP, alert=EMBEDDED)


def explanation_doc(spark, sf):
    docs = pipeline.explain_with(_decided(_scored(spark, sf)), POLICY, FMAP)
    return docs.selectExpr(
        "doc_id", "model_version", "predicted_score", "predicted_label", "tag", "action",
        "reason", "recommendation", "timestamp", "cast(size(features) AS BIGINT) AS n_features",
        "array_join(transform(top_features, t -> format_string('%s=%.3f', t.feature, t.impact)), "
        "';') AS top")


def findings_doc(spark, sf):
    docs = findings_documents(rank_features(_decided(_scored(spark, sf)), NAMES, 12), NAMES)
    return docs.selectExpr(
        "doc_id", "findings.model.score AS score", "findings.model.label AS label",
        "findings.policy.source AS source", "findings.policy.threshold AS threshold",
        "findings.policy.tag AS tag", "findings.policy.do_shap AS do_shap",
        "cast(findings.policy.top_k_effective AS BIGINT) AS top_k",
        "findings.explanation.reason AS reason")


def top_features(spark, sf):
    docs = rank_features(_decided(_scored(spark, sf)), NAMES, 12)
    return valid_attributions(docs)


def dashboard_page(spark, sf):
    newest = dashboard.newest(fixtures.alerts(spark, sf))
    docs = _documents(weaklabel.weak_score(newest).withColumn("score", F.col("weak_score")))
    return dashboard.page(dashboard.ranked(docs), 2)


def _selected(spark, sf) -> DataFrame:
    newest = dashboard.newest(fixtures.alerts(spark, sf), 1)
    return _documents(weaklabel.weak_score(newest).withColumn("score", F.col("weak_score")))


def dashboard_selected(spark, sf):
    return dashboard.feature_lines(dashboard.selected(_selected(spark, sf)))


def summary_rows(spark, sf):
    return dashboard.summary_rows(dashboard.selected(_selected(spark, sf)))


def raw_lines(spark, sf):
    return dashboard.raw_lines(dashboard.selected(_selected(spark, sf)))


def feedback_metrics(spark, sf):
    return feedback.feedback_metrics(feedback.clamp_trust(fixtures.feedback(spark, sf)))


def feedback_metrics_pct(spark, sf):
    return feedback.feedback_summary(feedback.clamp_trust(fixtures.feedback(spark, sf)))


def feedback_join(spark, sf):
    docs = weak_score(spark, sf).selectExpr("doc_id", "weak_score AS predicted_score")
    joined = feedback.join_explanations(
        feedback.clamp_trust(fixtures.feedback(spark, sf)), docs)
    return joined.groupBy("trust_score").agg(
        F.count("*").alias("n"), F.count("doc_id").alias("explained"),
        F.round(F.avg("predicted_score"), 9).alias("score_mean"))


def latency_summary(spark, sf):
    out = latency.latency_summary(fixtures.latency(spark, sf))
    return out.withColumn("mean", F.round("mean", 6))


def _rounds(spark, sf) -> DataFrame:
    sources, _ = pol.policy_tables(spark, POLICY)
    scored = pol.join_threshold(_sourced(spark, sf), sources, POLICY).select("doc_id", "weak_points", "threshold")
    # Each alert becomes many records: they are made and measured in as many tasks as a shuffle has.
    return fixtures.rounds(scored.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def consistency_flip(spark, sf):
    return consistency.label_flips(_rounds(spark, sf)).select(
        "key", F.array_join("label_set", ",").alias("label_set"), "label_flip_rate")


def consistency_score(spark, sf):
    return consistency.score_spread(_rounds(spark, sf)).select(
        "key", F.round("score_std", 9).alias("score_std"),
        F.round("score_max_delta", 9).alias("score_max_delta"))


def _overlap(spark, sf) -> DataFrame:
    return consistency.explanation_overlap(_rounds(spark, sf))


def consistency_jaccard(spark, sf):
    return _overlap(spark, sf).select("key", F.round("topfeat_jaccard_mean_vs_r1", 9)
                                      .alias("topfeat_jaccard_mean_vs_r1"))


def consistency_spearman(spark, sf):
    return _overlap(spark, sf).select("key", F.round("impact_spearman_mean_vs_r1", 9)
                                      .alias("impact_spearman_mean_vs_r1"))


def _report(spark, sf) -> DataFrame:
    return consistency.consistency_report(_rounds(spark, sf))


def consistency_summary(spark, sf):
    out = consistency.consistency_summary(_report(spark, sf))
    return out.select("alerts", "rounds", *[F.round(c, 8).alias(c) for c in
                                            ("flip_rate_mean", "jaccard_mean", "score_std_mean")])


def consistency_gaps(spark, sf):
    """The report where every third alert lacks its first round and every fifth comes twice."""
    rows = _rounds(spark, sf).where("NOT (i % 3 = 0 AND round = 1)")
    rows = rows.unionByName(rows.where("i % 5 = 0").withColumn("i", F.expr("i + 1000000000")))
    return consistency.consistency_report(rows).select(
        "key", "rounds", F.array_join("label_set", ",").alias("label_set"), "label_flip_rate",
        *[F.round(c, 9).alias(c) for c in ("score_std", "score_max_delta",
                                           "topfeat_jaccard_mean_vs_r1")])


def worst_ten(spark, sf):
    rounded = _report(spark, sf).withColumn(
        "topfeat_jaccard_mean_vs_r1", F.round("topfeat_jaccard_mean_vs_r1", 9))
    return consistency.worst(rounded).select("key", "label_flip_rate",
                                             "topfeat_jaccard_mean_vs_r1")


def _judged(spark, sf) -> DataFrame:
    """Stand-in scores against labels taken from the event type."""
    truth = fixtures.events_table(spark, sf).selectExpr(
        "cast(event_id AS STRING) AS doc_id",
        "CASE WHEN event_type IN ('error', 'purchase') THEN 1L ELSE 0L END AS label")
    return weak_score(spark, sf).withColumnRenamed("weak_score", "score").join(truth, "doc_id")


def average_precision_query(spark, sf):
    return average_precision(_judged(spark, sf)).select(
        F.round("average_precision", 9).alias("average_precision"), "positives", "n")


def score_quantile_query(spark, sf):
    return score_quantile(weak_score(spark, sf), "weak_score").select(
        "n", F.round("cut", 9).alias("cut"))


def class_report(spark, sf):
    judged = _judged(spark, sf).withColumn("predicted", F.expr("if(score >= 0.5D, 1L, 0L)"))
    return classification_report(judged).select(
        "name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def rolling_counters(spark, sf):
    canon = _canon(spark, sf, ("doc_id", "event_ts"))
    return rolling.rolling_counters(canon).select(
        "doc_id", "auth_fail_5m", "auth_fail_1h", "conn_count_5m")


def tumbling_volume(spark, sf):
    return rolling.tumbling_volume(fixtures.alerts(spark, sf))


def _messages(spark, sf) -> DataFrame:
    logs = fixtures.alerts(spark, sf).select(F.col("full_log").alias("message"))
    talk = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("text").alias("message"))
    return logs.unionByName(talk)


def masked_templates(spark, sf):
    return templates.masked_templates(_messages(spark, sf))


def log_templates(spark, sf):
    return templates.log_templates(_messages(spark, sf))


def _all_messages(spark, sf) -> DataFrame:
    """Messages of alerts, conversations and documents with where they come from."""
    logs = fixtures.alerts(spark, sf).selectExpr("'alert' AS origin", "doc_id AS key", "full_log AS message")
    talk = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "'conversation' AS origin", "concat(conv_id, ':', turn) AS key", "text AS message")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "'document' AS origin", "cast(doc_id AS STRING) AS key", "text AS message")
    return logs.unionByName(talk).unionByName(docs)


def mined_templates(spark, sf):
    return template_tree.mined_templates(_all_messages(spark, sf))


def message_templates(spark, sf):
    """The template of every message."""
    return template_tree.labelled_messages(_all_messages(spark, sf)).select("origin", "key", "template_id")


def resampled(spark, sf):
    return sampling.resample(fixtures.alerts(spark, sf).select("doc_id"), 1000)


def shuffled(spark, sf):
    return sampling.shuffled(fixtures.alerts(spark, sf).select("doc_id"))


def random_pick(spark, sf):
    return sampling.random_k(fixtures.alerts(spark, sf).select("doc_id"), 100)


def sampling_properties(spark, sf):
    """What the seeded picks hold, whatever rows the seed gives."""
    alerts = fixtures.alerts(spark, sf).select("doc_id")
    known = alerts.withColumn("known", F.lit(1))
    drawn = sampling.resample(alerts, 1000).join(known, "doc_id", "left").agg(
        F.count("*").alias("drawn"), F.count("known").alias("drawn_known"))
    order = sampling.shuffled(alerts).agg(
        F.count("*").alias("shuffled"), F.countDistinct("doc_id").alias("different"),
        F.countDistinct("row_no").alias("places"), F.max("row_no").alias("last_place"))
    picked = sampling.random_k(alerts, 100).join(known, "doc_id").agg(F.countDistinct("doc_id").alias("picked"))
    return drawn.join(order).join(picked)  # one row each


def model_properties(spark, sf):
    """What scores, attributions, prototypes and reports must satisfy whatever the forest learned."""
    run = trained(spark, sf)
    scored = run.model.score(_features(spark, sf)).agg(
        F.count("*").alias("scored"),
        F.count_if(F.expr("score BETWEEN 0 AND 1 AND raw_score BETWEEN 0 AND 1")).alias("in_range"))
    ordered = ("forall(sequence(1, greatest(size(top_features) - 1, 1)), i -> i >= size(top_features) OR "
               "abs(top_features[i - 1].impact) >= abs(top_features[i].impact)) AND "
               "forall(top_features, t -> t.value <> 0)")
    told = [training.explain(fixtures.alerts(spark, sf), run, POLICY, FMAP, m).agg(
        F.count_if(F.expr(ordered)).alias(f"{m}_ordered")) for m in ("tree", "background", "importances")]
    weight = run.prototypes().agg(F.round(F.sum("weight")).cast("bigint").alias("prototype_rows"))
    precision, _, report = run.evaluation()
    tested = precision.select(F.col("n").alias("tested"), F.expr("average_precision BETWEEN 0 AND 1").alias("ap_in_range"))
    support = report.where("name IN ('0', '1')").agg(F.sum("support").cast("bigint").alias("supported"))
    out = scored
    for one in (*told, weight, tested, support):
        out = out.join(one)  # one row each
    return out


_TRAINED: dict[tuple[str, str], training.Trained] = {}


def trained(spark: SparkSession, sf: str) -> training.Trained:
    """The model of a table set, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = training.train(fixtures.alerts(spark, sf), FMAP)
    return _TRAINED[key]


def model_split(spark, sf):
    return trained(spark, sf).parts.groupBy("label", "part").agg(F.count("*").alias("n"))


def _features(spark, sf) -> DataFrame:
    return project_features(_canon(spark, sf), FMAP)


def forest_score(spark, sf):
    return trained(spark, sf).model.score(_features(spark, sf)).select(
        "doc_id", "raw_score", "score")


def _explained(method: str):
    def query(spark, sf):
        docs = training.explain(fixtures.alerts(spark, sf), trained(spark, sf), POLICY, FMAP, method)
        return docs.select("doc_id", "predicted_score", "predicted_label", "tag", "reason",
                           F.to_json("top_features").alias("top_features"))
    return query


def attribution_additivity(spark, sf):
    """Largest gap between the forest score and base value plus attributions."""
    run = trained(spark, sf)
    rows = run.attributed(run.model.score(_features(spark, sf)))
    gap = f"abs(aggregate(phi, 0D, (s, x) -> s + x) + {run.leaves.expected()!r}D - raw_score)"
    return rows.agg(F.count("*").alias("n"), (F.max(F.expr(gap)) < 1e-9).alias("additive"))


def prototypes(spark, sf):
    return trained(spark, sf).prototypes()


def model_evaluation(spark, sf):
    precision, cut, _ = trained(spark, sf).evaluation()
    return precision.withColumn("cut", cut.select("cut").scalar())


def model_class_report(spark, sf):
    return trained(spark, sf).evaluation()[2]


QUICK = ForestSettings(trees=20, depth=5, min_leaf=20, prototypes=10)


def stored_model_equals(spark, sf):
    """Documents made by a stream with a stored and loaded model, features enriched, against those of a
    batch with the model that was trained; and how many are equal."""
    from alertloom.models import bundle
    from alertloom.streaming.ingest import score_stream
    alerts, path = fixtures.alerts(spark, sf), new_path(spark, "stored")
    run = training.train(alerts, FMAP, QUICK, enrich=True)
    run.packed().save(f"{path}/model", 1)
    loaded = bundle.load(spark, f"{path}/model")
    source = spark.readStream.schema(alerts.schema).parquet(fixtures.alerts_path(spark, sf))
    score_stream(source, lambda batch: training.explain(batch, loaded, POLICY), f"{path}/out",
                 f"{path}/checkpoint", min_level=0).awaitTermination()
    key = ["doc_id", "predicted_score", "predicted_label", "tag", "reason", "recommendation"]
    streamed = spark.read.parquet(f"{path}/out/explanations").select(*key, F.lit(1).alias("hit"))
    joined = training.explain(alerts, run, POLICY).select(*key).join(streamed, key, "left")
    return joined.agg(F.count("*").alias("n"), F.count("hit").alias("equal"))


def model_less(spark, sf):
    """Explanations without a model: one half for everyone, judged by each source's threshold."""
    docs = training.explain(fixtures.alerts(spark, sf), Bundle(FMAP), POLICY)
    return docs.selectExpr("doc_id", "predicted_score", "predicted_label", "reason",
                           "cast(size(top_features) AS BIGINT) AS top")


def stream_equals_batch(spark, sf):
    """Streams the alert table into the explanation store and counts documents equal to batch."""
    from alertloom.streaming.ingest import score_stream
    alerts = fixtures.alerts(spark, sf)
    path = new_path(spark, "stream")
    source = spark.readStream.schema(alerts.schema).parquet(fixtures.alerts_path(spark, sf))
    query = score_stream(source, _stand_in_documents, f"{path}/out", f"{path}/checkpoint",
                         min_level=0)
    query.awaitTermination()
    streamed = spark.read.parquet(f"{path}/out/explanations")
    key = ["doc_id", "predicted_score", "predicted_label", "tag", "reason", "recommendation"]
    batch = _stand_in_documents(alerts).select(*key)
    joined = batch.join(streamed.select(*key, F.lit(1).alias("hit")), key, "left")
    return joined.agg(F.count("*").alias("n"), F.count("hit").alias("equal"))


def _drained(spark, frame: DataFrame, path: str) -> DataFrame:
    """All that a stream emits for what its source holds now."""
    query = (frame.writeStream.format("parquet").option("path", f"{path}/out")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/out")


def stream_rolling_equals(spark, sf):
    """Rolling counters of the alert stream against the batch counters of the same rows.

    The stream emits the rows of all minutes that its watermark has passed.
    """
    from alertloom.streaming.stateful import rolling_stream
    alerts = fixtures.alerts(spark, sf)
    source = spark.readStream.schema(alerts.schema).parquet(fixtures.alerts_path(spark, sf))
    rows = rolling_stream(canonicalize(source, ("doc_id", "event_ts")), delay="0 seconds")
    streamed = _drained(spark, rows, new_path(spark, "rolling"))
    batch = rolling.rolling_counters(_canon(spark, sf, ("doc_id", "event_ts"))).where("coalesce(src_ip, '') <> ''")
    last = batch.agg(F.max(F.expr("unix_micros(event_ts) div 60000000 * 60000000")).alias("m")).select("m").scalar()
    final = batch.where(F.unix_micros("event_ts") < last).select("doc_id", *rolling.NAMES)
    joined = final.join(streamed.select("doc_id", *rolling.NAMES, F.lit(1).alias("hit")), ["doc_id", *rolling.NAMES], "left")
    return joined.agg(F.count("*").alias("n"), F.count("hit").alias("equal"))


def stream_counters(spark, sf):
    """Fates of the rows of a stream: all alerts, then every seventh again, some of them late, some
    texts that are no alerts."""
    from alertloom.streaming.ingest import alert_stream, run_counters, score_stream
    path = new_path(spark, "counted")
    alerts = fixtures.alerts(spark, sf).selectExpr(
        "doc_id", """concat('{"timestamp": "', timestamp, '", ', substring(raw, 2)) AS raw""")
    again = alerts.where("cast(doc_id AS BIGINT) % 7 = 0").select("raw")
    broken = alerts.where("cast(doc_id AS BIGINT) % 100 = 0").select(F.concat(F.lit("cut off "), "raw").alias("raw"))
    for rows in (alerts.select("raw"), again.unionByName(broken)):
        rows.select(F.col("raw").alias("value")).write.mode("append").text(f"{path}/in")
        score_stream(alert_stream(spark, f"{path}/in"), _stand_in_documents, f"{path}/out", f"{path}/checkpoint",
                     min_level=4, dump_only=True).awaitTermination()
    return run_counters(spark, f"{path}/out")


def _stand_in_documents(alerts: DataFrame) -> DataFrame:
    scored = weaklabel.weak_score(alerts).withColumn("score", F.col("weak_score"))
    return pipeline.explain_with(_decided(scored), POLICY, FMAP)


def parsed_alerts(spark, sf):
    """The raw JSON text through the parser, summarised by what comes out."""
    from alertloom.sources.files import parse_alerts, usable
    text = fixtures.alerts(spark, sf).select(F.col("raw").alias("value"))
    return (usable(parse_alerts(text))
            .groupBy(F.col("decoder.name").alias("decoder"),
                     F.array_join("rule.groups", ",").alias("rule_groups"))
            .agg(F.count("*").alias("n"), F.sum(F.col("rule.level").cast("bigint")).alias("levels"),
                 F.count("data.srcip").alias("with_srcip"),
                 F.count_if("has_win_event").alias("with_event")))


def enriched_features(spark, sf):
    """Features with DNS, RDP, private address, hour and rolling columns filled."""
    rows = pipeline.feature_rows(fixtures.alerts(spark, sf), FMAP, enrich=True)
    return rows.select("doc_id", "service_dns", "logon_type_rdp", "src_private", "dst_private",
                       "hour", "auth_fail_5m", "auth_fail_1h", "conn_count_5m")


def provenance_join(spark, sf):
    """Documents back to the raw alerts they were made from, by index and document id."""
    raw = fixtures.alerts(spark, sf).selectExpr(
        "substring(timestamp, 1, 10) AS day", "doc_id AS _os_doc_id", "raw"
    ).selectExpr("concat('alerts-', day) AS _os_index", "_os_doc_id", "length(raw) AS size")
    docs = weaklabel.weak_score(fixtures.alerts(spark, sf)).selectExpr(
        "concat('alerts-', substring(timestamp, 1, 10)) AS _os_index", "doc_id AS _os_doc_id",
        "weak_points")
    return feedback.join_provenance(docs, raw).groupBy("_os_index").agg(
        F.count("*").alias("n"), F.sum("weak_points").alias("points"),
        F.sum("size").cast("bigint").alias("raw_chars"))


QUERIES = {
    "source_detect": source_detect,
    "policy_source": policy_source,
    "canonical_network": _mapped("network"),
    "canonical_windows": _mapped("windows"),
    "canonical_linux": _mapped("linux"),
    "canonical_openstack": _mapped("openstack"),
    "canonical_generic": _mapped("generic"),
    "canonical_summary": canonical_summary,
    "derived_flags": derived_flags,
    "service_norm": service_norm,
    "severity_ord": severity_ord,
    "feature_vector": feature_vector,
    "compact_vector": compact_vector,
    "nonzero_features": nonzero_features,
    "min_level_keyword": min_level_keyword,
    "time_window_scan": time_window_scan,
    "scan_counters": scan_counters,
    "incremental_page": incremental_page,
    "cursor_pages": cursor_pages,
    "backfill_last_n": backfill_last_n,
    "weak_score": weak_score,
    "weak_label": weak_label,
    "class_balance": class_balance,
    "policy_threshold_label": policy_threshold_label,
    "policy_band": policy_band,
    "policy_override_intended": _override("intended"),
    "policy_override_observed": _override("observed"),
    "attribution_budget": attribution_budget,
    "explanation_doc": explanation_doc,
    "findings_doc": findings_doc,
    "top_features": top_features,
    "dashboard_page": dashboard_page,
    "dashboard_selected": dashboard_selected,
    "summary_rows": summary_rows,
    "raw_lines": raw_lines,
    "feedback_metrics": feedback_metrics,
    "feedback_metrics_pct": feedback_metrics_pct,
    "feedback_join": feedback_join,
    "latency_summary": latency_summary,
    "consistency_flip": consistency_flip,
    "consistency_score": consistency_score,
    "consistency_jaccard": consistency_jaccard,
    "consistency_spearman": consistency_spearman,
    "consistency_summary": consistency_summary,
    "consistency_gaps": consistency_gaps,
    "worst_ten": worst_ten,
    "average_precision": average_precision_query,
    "score_quantile": score_quantile_query,
    "class_report": class_report,
    "rolling_counters": rolling_counters,
    "tumbling_volume": tumbling_volume,
    "masked_templates": masked_templates,
    "log_templates": log_templates,
    "mined_templates": mined_templates,
    "message_templates": message_templates,
    "resample": resampled,
    "shuffle": shuffled,
    "random_pick": random_pick,
    "sampling_properties": sampling_properties,
    "parsed_alerts": parsed_alerts,
    "enriched_features": enriched_features,
    "provenance_join": provenance_join,
    "stream_equals_batch": stream_equals_batch,
    "stream_rolling_equals": stream_rolling_equals,
    "stream_counters": stream_counters,
    "stored_model_equals": stored_model_equals,
    "model_less": model_less,
    "model_split": model_split,
    "forest_score": forest_score,
    "tree_attribution": _explained("tree"),
    "background_attribution": _explained("background"),
    "importance_fallback": _explained("importances"),
    "attribution_additivity": attribution_additivity,
    "prototypes": prototypes,
    "model_evaluation": model_evaluation,
    "model_class_report": model_class_report,
    "model_properties": model_properties,
}
