"""Rule generation.

From scored events to rule lines as one plan:

    policy  -> anomalies under the threshold, not towards local services,
               with the per (source, port) frequency and the drop decision
    dedup   -> lowest score per (proto, src, dest, port)            (W5)
    flows   -> lowest score per (src, dest, port), then admissible  (W6, P15)
    scans   -> sources touching more than 10 distinct ports        (A9)
    context -> port-range rules for sources with > 10 stored events (A10)
    merge   -> new rules minus existing headers / texts, appended   (J7, U1)

De-duplication keeps the minimum of a struct ordered (score, event_id, ...):
a partially aggregated groupBy, so a key with millions of rows is reduced
map-side instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.hashing import sha_mod
from netsleuth.functions.ip import canonical_ip
from netsleuth.functions.ruletext import fmt2, header, is_comment, is_managed, num_text, sid_of

FLOW_KEYS_W5 = ["proto", "src_ip", "dest_ip", "dest_port"]
FLOW_KEYS_W6 = ["src_ip", "dest_ip", "dest_port"]


def policy(scored: DataFrame, thr: float, score_col: str = "anomaly_score",
           local_services=K.LOCAL_SERVICES) -> DataFrame:
    """P12 (prediction -1 and score < thr), P13 (not towards ``local_services``),
    A8 (anomalies per (src_ip, dest_port), grouped and joined back) and P14
    (``should_drop``)."""
    a = (scored.withColumn("dest_port", F.coalesce(F.col("dest_port").try_cast("int"), F.lit(0)))
               .where((F.col("prediction") == K.ANOMALY_PREDICTION)
                      & ~F.coalesce(F.col("dest_ip").cast("string").isin(*local_services), F.lit(False))
                      & (F.col(score_col) < F.lit(thr))))
    freq = a.groupBy("src_ip", "dest_port").agg(F.count(F.lit(1)).alias("freq_sp"))
    a = a.join(freq, ["src_ip", "dest_port"], "left")
    sev = F.coalesce(F.col("alert_severity").try_cast("int"), F.lit(0))
    drop = ((sev >= K.MIN_SEVERITY_TO_DROP) & (F.col("freq_sp") >= K.MIN_FREQ_TO_DROP)
            & ~F.col("dest_port").isin(*K.ALERT_ONLY_PORTS))
    return a.withColumn("should_drop", F.coalesce(drop, F.lit(False)))


def keep_lowest(df: DataFrame, keys: list[str], score_col: str = "anomaly_score",
                tie_col: str = "event_id") -> DataFrame:
    """One row per ``keys``: the lowest (score, tie) row, via ``min(struct)``."""
    others = [c for c in df.columns if c not in keys and c not in (score_col, tie_col)]
    packed = F.struct(F.col(score_col).alias("_s"), F.col(tie_col).alias("_t"), *[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.min(packed).alias("_r"))
              .select(*keys, F.col("_r._s").alias(score_col), F.col("_r._t").alias(tie_col),
                      *[F.col(f"_r.{c}").alias(c) for c in others]))


def dedup(anomalies: DataFrame) -> DataFrame:
    """Lowest score per (proto, src, dest, port)."""
    return keep_lowest(anomalies, FLOW_KEYS_W5)


def flow_candidates(deduped: DataFrame) -> DataFrame:
    """Lowest score per (src, dest, port) *before* admissibility, so an
    inadmissible first row (e.g. ICMP) still blocks later ones."""
    return keep_lowest(deduped, FLOW_KEYS_W6)


def flow_rules(candidates: DataFrame, thr: float, score_col: str = "anomaly_score") -> DataFrame:
    """P15 + F2 + F13 + F14: admissible candidates -> rule text.

    Admissible: protocol tcp/udp, both addresses valid, destination port > 0.
    ``drop`` only when the drop policy holds, the port is not alert-only and
    the score is under the threshold; otherwise ``alert``.
    """
    candidates = (candidates.withColumn("_src", canonical_ip("src_ip"))
                            .withColumn("_dst", canonical_ip("dest_ip")))
    proto = F.lower(F.col("proto").cast("string"))
    src, dst = F.col("_src"), F.col("_dst")
    dport = F.col("dest_port").cast("int")
    sp = F.col("src_port").try_cast("int")
    src_port = F.when(F.coalesce(sp, F.lit(0)) != 0, sp.cast("string")).otherwise(F.lit(K.ANY_PORT))
    sev = F.coalesce(F.col("alert_severity").try_cast("int"), F.lit(0))
    pkt = F.coalesce(F.col("packet_length").try_cast("int"), F.lit(0))
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0))
    readable = F.col("src_port").isNull() | sp.isNotNull()      # a port that is no number gives no rule
    ok = proto.isin("tcp", "udp") & src.isNotNull() & dst.isNotNull() & (dport > 0) & readable
    drop = (F.col("should_drop") & ~dport.isin(*K.ALERT_ONLY_PORTS) & (score < F.lit(thr)))
    action = F.when(F.coalesce(drop, F.lit(False)), "drop").otherwise("alert")
    uid = F.concat_ws("-", src, dst, proto, dport.cast("string"), sev.cast("string"), pkt.cast("string"),
                      num_text(score, K.SCORE_ID_DECIMALS))
    base, mod = K.SID_FLOW_RULE
    sid = sha_mod(uid, mod, base)
    msg = F.format_string(K.FLOW_RULE_MESSAGE, fmt2(score), pkt, sev, fmt2(F.lit(thr)))
    text = F.format_string(K.FLOW_RULE_FORMAT, action, proto, src, src_port, dst, dport, msg, sid)
    return candidates.where(ok).select("event_id", "src_ip", "dest_ip", "dest_port", score.alias("anomaly_score"),
                                       action.alias("action"), sid.alias("sid"), text.alias("text"))


def scan_rules(deduped: DataFrame, port_col: str = "dest_port", min_ports: int = K.SCAN_MIN_PORTS) -> DataFrame:
    """A9 + F16: one ``alert ip`` rule per source with more than ``min_ports``
    distinct ports among its de-duplicated anomalies (``port_col='src_port'``
    reproduces the reference's choice)."""
    per = deduped.groupBy("src_ip").agg(F.count_distinct(port_col).alias("n_ports")) \
                 .where(F.col("n_ports") > min_ports)
    per = per.withColumn("_ip", canonical_ip("src_ip"))
    ip = F.col("_ip")
    base, mod = K.SID_SCAN_RULE
    sid = sha_mod(ip, mod, base)
    text = F.format_string(K.SCAN_RULE_FORMAT, ip, ip, sid)
    return per.where(ip.isNotNull()).select("src_ip", "n_ports", sid.alias("sid"), text.alias("text"))


def history_stats(history: DataFrame, min_events: int = K.CONTEXT_MIN_EVENTS) -> DataFrame:
    """A10 + J6: rows and port range per source of the stored history,
    aggregated once (instead of one scan per event)."""
    return history.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n_hist"),
                                         F.min("dest_port").alias("port_min"), F.max("dest_port").alias("port_max")) \
                  .where(F.col("n_hist") > min_events)


def contextual_rules(deduped: DataFrame, history: DataFrame | None, summary: DataFrame | None = None) -> DataFrame:
    """``alert <proto> <src> any -> any <min>:<max>`` for each anomaly
    whose source has more than 10 stored events; distinct texts.  ``summary``:
    ``history_stats`` that is known already."""
    h = history_stats(history) if summary is None else summary
    j = deduped.join(h, "src_ip", "inner")
    base, mod = K.SID_CONTEXT_RULE
    sid = sha_mod(F.concat_ws("-", F.col("src_ip"), F.col("dest_port").cast("string"), F.col("proto")), mod, base)
    text = F.format_string(K.CONTEXT_RULE_FORMAT, F.col("proto"), F.col("src_ip"), F.col("port_min"),
                           F.col("port_max"), F.col("src_ip"), sid)
    return j.select(sid.alias("sid"), text.alias("text")).distinct()


def parse_rule_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Rule file lines -> ``(line_no?, text, rule, enabled, header,
    sid, managed)``; blank lines dropped, ``#`` marks a disabled rule."""
    t = F.trim(F.col(text_col))
    d = lines.withColumn("_t", t).where(F.col("_t") != "")
    rule = F.regexp_replace(F.col("_t"), r"^#+\s*", "")
    return (d.withColumn("enabled", ~is_comment("_t"))
             .withColumn("rule", rule)
             .withColumn("header", header(rule))
             .withColumn("sid", sid_of(rule))
             .withColumn("managed", is_managed(rule))
             .withColumnRenamed("_t", "text"))


def new_rules(existing: DataFrame, scans: DataFrame, context: DataFrame, flows: DataFrame) -> DataFrame:
    """J7 + U2 + U3: candidates minus what the rule file already has.

    Scan and per-flow rules are new when their header is new (and, for flow
    rules, their text); contextual rules when their text is new.  Existing
    rules count whether enabled or disabled, so a rule switched off by hand
    is not silently re-added.  ``(kind, sid, text)``.
    """
    ex = existing.select("rule", "header")
    hdrs = ex.select(F.col("header").alias("h")).distinct()
    texts = ex.select(F.col("rule").alias("r")).distinct()
    s = scans.select(F.lit("scan").alias("kind"), "sid", "text")
    c = context.select(F.lit("context").alias("kind"), "sid", "text")
    f = flows.select(F.lit("flow").alias("kind"), "sid", "text")
    s = s.join(hdrs, header(s["text"]) == hdrs["h"], "left_anti")
    f = f.join(hdrs, header(f["text"]) == hdrs["h"], "left_anti")
    cand = s.unionByName(f).unionByName(c)
    return cand.join(texts, cand["text"] == texts["r"], "left_anti").distinct()


def merge_rule_file(existing: DataFrame, new: DataFrame) -> DataFrame:
    """K6 + U1: the new rule file: every existing line (with its enabled flag,
    in place) followed by the new rules (scan, context, flow; by text).

    -> ``(section, line_no, kind, text, enabled)``; write it ordered by
    ``section, line_no, kind, text``."""
    kind_rank = F.when(F.col("kind") == "scan", 0).when(F.col("kind") == "context", 1).otherwise(2)
    old = existing.select(F.lit(0).alias("section"), F.col("line_no"), F.lit("existing").alias("kind"),
                          "text", "enabled")
    add = new.select(F.lit(1).alias("section"), kind_rank.cast("long").alias("line_no"), "kind", "text",
                     F.lit(True).alias("enabled"))
    return old.unionByName(add)


def toggle(lines: DataFrame, toggles: DataFrame, text_col: str = "text") -> DataFrame:
    """Apply ``(sid, status)`` toggles: ``disable`` adds one ``#`` unless
    the line already starts with one, ``enable`` strips every leading ``#``.
    Lines are matched on their ``sid:N;`` option (a broadcast-free equi-join
    on the extracted sid).  Of several toggles for one sid the last counts, by
    ``at`` if there is such a column; without it a ``disable`` wins."""
    t = toggles.select(F.col("sid").cast("bigint").alias("_sid"), F.lower("status").alias("_status"),
                       (F.col("at") if "at" in toggles.columns else F.lit(0)).alias("_at"))
    rank = F.struct("_at", F.when(F.col("_status") == "disable", 1).otherwise(0).alias("d"))
    t = t.groupBy("_sid").agg(F.max_by("_status", rank).alias("_status"))
    d = lines.withColumn("_lsid", sid_of(F.regexp_replace(F.col(text_col), r"^#+", "")))
    d = d.join(t, d["_lsid"] == t["_sid"], "left")
    txt = F.col(text_col)
    out = (F.when((F.col("_status") == "disable") & ~txt.startswith("#"), F.concat(F.lit("#"), txt))
            .when(F.col("_status") == "enable", F.regexp_replace(txt, r"^#+", ""))
            .otherwise(txt))
    return d.withColumn(text_col, out).drop("_lsid", "_sid", "_status")


def sid_collisions(rules: DataFrame) -> DataFrame:
    """Q17: sids shared by different rule texts: their number, the first and
    the last of them."""
    return rules.groupBy("sid").agg(F.count_distinct("text").alias("n_texts"), F.min("text").alias("first_text"),
                                    F.max("text").alias("last_text")).where(F.col("n_texts") > 1)


def inventory(lines: DataFrame) -> DataFrame:
    """S10 + P17: per rule file: rules, enabled, disabled, managed (per-address
    ``drop ip``/``alert ip``), manual, distinct headers."""
    p = parse_rule_lines(lines)
    return p.groupBy("file").agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(F.col("enabled")).alias("enabled"),
        F.count_if(~F.col("enabled")).alias("disabled"),
        F.count_if(F.col("managed")).alias("managed"),
        F.count_if(~F.col("managed")).alias("manual"),
        F.count_distinct("header").alias("headers"))


def generate(scored: DataFrame, history: DataFrame | None, thr: float, existing: DataFrame | None = None,
             port_col: str = "dest_port", checkpoint: bool = True, local_services=K.LOCAL_SERVICES,
             policy_rows: DataFrame | None = None, history_rows: DataFrame | None = None) -> dict:
    """M10's rule half: every intermediate of one generation run.

    The policy output (the anomalies under the threshold: a small fraction of
    the scored events) feeds four branches; it is checkpointed once so the
    scoring plan is not re-run per branch.  ``policy_rows`` and
    ``history_rows`` (``history_stats``) are taken as they are if given."""
    pol = policy(scored, thr, local_services=local_services) if policy_rows is None else policy_rows
    if checkpoint and policy_rows is None:
        from netsleuth.session import materialize
        pol = materialize(pol)
    d5 = dedup(pol)
    cands = flow_candidates(d5)
    fr = flow_rules(cands, thr)
    sr = scan_rules(d5, port_col)
    cr = contextual_rules(d5, history, history_rows)
    if existing is None:
        spark = scored.sparkSession
        existing = parse_rule_lines(spark.createDataFrame([], "value string, line_no long"))
    nr = new_rules(existing, sr, cr, fr)
    return {"policy": pol, "dedup": d5, "candidates": cands, "flow_rules": fr, "scan_rules": sr,
            "context_rules": cr, "new_rules": nr}
