"""The catalogued queries as plain SQL over the source tables, for comparison in DuckDB."""

from beaconlake.plans.catalog import PATH_MAP, PROFILE_STATISTICS, SSID_MAP, START_US

BEACONS = """
e AS (
  SELECT event_id, CAST(user_id % 12 AS INT) AS ap,
         row_number() OVER (PARTITION BY user_id % 12 ORDER BY ts, event_id) AS k,
         count(*) OVER (PARTITION BY user_id % 12) AS n
  FROM events
), m AS (
  SELECT *, (k * 2 <= n) AS is_baseline, (k * 2 > n AND k % 60 BETWEEN 30 AND 45) AS burst,
         CAST(floor(k / 25.0) AS BIGINT) AS pause
  FROM e
), beacons AS (
  SELECT event_id AS frame_id,
    concat('LAB_AP_', lpad(CAST(ap % 9 AS VARCHAR), 2, '0')) AS ssid,
    concat('02:10:00:00:00:', lpad(CAST(ap AS VARCHAR), 2, '0')) AS bssid,
    CAST(1704067200000000 + k*102400 + (event_id*7919) % 401 - 200 + pause*2500000 AS BIGINT) AS capture_us,
    CAST(k*102400 + pause*2500000 + ap*k
         + CASE WHEN burst AND ap % 3 = 2 AND k % 2 = 0 THEN 20000 ELSE 0 END AS BIGINT) AS beacon_timestamp,
    CAST((k + pause*25 + CAST(floor(k/200.0) AS BIGINT)*150
         - CASE WHEN burst AND ap % 3 = 1 AND k % 2 = 1 THEN 1 ELSE 0 END) % 4096 AS INT) AS seq_num,
    CAST(-45 - ap*2 - event_id % 9 AS INT) AS rssi,
    CAST(1 + ap % 11 AS INT) AS channel,
    CAST(100 AS INT) AS beacon_interval,
    CAST(CASE WHEN burst AND ap % 3 = 0 THEN 1041 ELSE 1073 END AS INT) AS capabilities,
    CASE WHEN burst AND ap % 3 = 0 THEN 'WEP' ELSE 'WPA2/WPA3' END AS security,
    CAST(CASE WHEN burst AND ap % 3 = 0 THEN 4 ELSE 18 + event_id % 2 END AS INT) AS ie_count,
    CAST(CASE WHEN burst AND ap % 3 = 2 THEN 4 ELSE 12 END AS INT) AS rate_count,
    CASE WHEN burst AND ap % 3 = 2 THEN '1.0,2.0,5.5,11.0'
         ELSE '1.0,2.0,5.5,6.0,9.0,11.0,12.0,18.0,24.0,36.0,48.0,54.0' END AS supported_rates,
    is_baseline, CAST(burst AS INT) AS label
  FROM m
)"""


def features(source: str, name: str = "features") -> str:
    """CTEs that add the sequential features to ``source``."""
    return f"""
{name}_lag AS (
  SELECT *,
    capture_us - lag(capture_us) OVER w AS gap,
    beacon_timestamp - lag(beacon_timestamp) OVER w AS tsf_gap,
    lag(seq_num) OVER w AS prev_seq,
    capture_us - lag(capture_us) OVER s AS seq_gap
  FROM {source}
  WINDOW w AS (PARTITION BY bssid ORDER BY capture_us, frame_id),
         s AS (PARTITION BY bssid, seq_num ORDER BY capture_us, frame_id)
), {name}_var AS (
  SELECT *, count(gap) OVER r AS gaps, var_pop(gap / 1000.0) OVER r AS gap_var,
    CAST(coalesce((seq_num - prev_seq + 4096) % 4096, 0) AS INT) AS seq_jump
  FROM {name}_lag
  WINDOW r AS (PARTITION BY bssid ORDER BY capture_us, frame_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), {name} AS (
  SELECT *,
    round(CASE WHEN seq_jump > 100 THEN least(1.0, seq_jump / 1000.0) WHEN seq_jump > 10 THEN 0.3
               ELSE 0.0 END, 4) AS seq_anomaly_score,
    CAST(coalesce(seq_gap > 1000 AND seq_gap < 500000, false) AS INT) AS is_seq_duplicate,
    round(coalesce(seq_gap / 1e6, 0.0), 6) AS seq_dup_delta,
    CASE WHEN gap BETWEEN 50000 AND 250000
         THEN round(CAST(tsf_gap - gap AS DOUBLE) / CAST(gap AS DOUBLE), 8) ELSE 0.0 END AS clock_skew,
    CAST(coalesce(gap BETWEEN 50000 AND 250000, false) AS INT) AS valid_skew,
    coalesce(gap / 1000.0, 0.0) AS inter_beacon_ms,
    CASE WHEN gaps >= 5 THEN round(gap_var, 6) ELSE 0.0 END AS timing_variance
  FROM {name}_var
)"""


MODES = [
    ("ssid", "'<Unknown>'"), ("ie_count", "0"), ("rate_count", "0"), ("security", "'Unknown'"),
    ("capabilities", "0"), ("channel", "0"), ("beacon_interval", "0"), ("supported_rates", "''"),
]


def _modes(source: str, name: str) -> str:
    return ", ".join(
        f"""{name}_{c} AS (
  SELECT bssid, {c} FROM (
    SELECT bssid, {c}, row_number() OVER (PARTITION BY bssid ORDER BY count(*) DESC, {c}) AS r
    FROM {source} WHERE {c} IS NOT NULL GROUP BY bssid, {c}) WHERE r = 1)"""
        for c, _ in MODES
    )


def _mode_joins(name: str) -> str:
    return " ".join(f"LEFT JOIN {name}_{c} USING (bssid)" for c, _ in MODES)


def _mode_columns(name: str) -> str:
    return ", ".join(f"coalesce({name}_{c}.{c}, {d}) AS {c}" for c, d in MODES)


def profiles(source: str, name: str = "profiles") -> str:
    """CTEs that build profiles from the feature rows ``source``."""
    return f"""
{name}_iqr AS (
  SELECT bssid, count(clock_skew) AS skews, quantile_cont(clock_skew, 0.25) AS q1,
         quantile_cont(clock_skew, 0.75) AS q3
  FROM {source} GROUP BY bssid
), {name}_kept AS (
  SELECT s.*, CASE WHEN skews <= 10 OR clock_skew BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)
                   THEN clock_skew END AS kept_skew,
         CASE WHEN seq_jump < 100 THEN seq_jump END AS kept_jump
  FROM {source} s JOIN {name}_iqr USING (bssid)
), {name}_stats AS (
  SELECT bssid,
    coalesce(avg(kept_skew), 0.0) AS clock_skew_mean, coalesce(stddev_samp(kept_skew), 0.0) AS clock_skew_std,
    coalesce(min(kept_skew), 0.0) AS clock_skew_min, coalesce(max(kept_skew), 0.0) AS clock_skew_max,
    coalesce(avg(rssi), 0.0) AS rssi_mean, coalesce(stddev_samp(rssi), 0.0) AS rssi_std,
    CAST(coalesce(min(rssi), 0) AS DOUBLE) AS rssi_min, CAST(coalesce(max(rssi), 0) AS DOUBLE) AS rssi_max,
    coalesce(avg(kept_jump), 0.0) AS seq_jump_mean, coalesce(stddev_samp(kept_jump), 0.0) AS seq_jump_std,
    count(*) AS total_beacons
  FROM {name}_kept GROUP BY bssid HAVING count(*) >= 10
), {_modes(source, name)}, {name} AS (
  SELECT st.*, {_mode_columns(name)} FROM {name}_stats st {_mode_joins(name)}
)"""


def evidence(source: str, profile: str = "profiles") -> str:
    """CTE ``scored``: rule flags, suspicion, score and reasons for the rows of ``source``."""
    z = "abs(f.clock_skew - p.clock_skew_mean) / p.clock_skew_std"
    return f"""
flags AS (
  SELECT f.*, p.bssid IS NOT NULL AS known, p.ie_count AS p_ie, p.security AS p_sec,
    p.rate_count AS p_rate, CASE WHEN p.clock_skew_std > 0 THEN {z} END AS z,
    CAST(coalesce(p.bssid IS NOT NULL AND is_seq_duplicate = 1, false) AS INT) AS ev_duplicate_sequence,
    CAST(coalesce(abs(f.ie_count - p.ie_count) >= 3, false) AS INT) AS ev_ie_count,
    CAST(coalesce(f.security <> p.security, false) AS INT) AS ev_security,
    CAST(coalesce(abs(f.rate_count - p.rate_count) >= 3, false) AS INT) AS ev_rate_count,
    CAST(coalesce(valid_skew = 1 AND p.clock_skew_std > 0 AND {z} > 10 AND abs(f.clock_skew) > 0.0005,
                  false) AS INT) AS ev_timing
  FROM {source} f LEFT JOIN {profile} p ON f.bssid = p.bssid
), points AS (
  SELECT *, 90*ev_duplicate_sequence + 70*ev_ie_count + 60*ev_security + 30*ev_rate_count
            + 35*ev_timing AS pts
  FROM flags
), scored AS (
  SELECT *, CAST(ev_duplicate_sequence + ev_ie_count + ev_security > 0 OR pts >= 75 AS INT) AS suspicious,
    least(100, pts) / 100.0 AS threat_score,
    concat_ws(' ',
      CASE WHEN ev_duplicate_sequence = 1 THEN 'Duplicate sequence activity: sequence ' || seq_num ||
        ' was observed again for the same BSSID within the configured short timing window.' END,
      CASE WHEN ev_ie_count = 1 THEN 'Beacon IE count deviation: observed ' || ie_count ||
        ' Information Elements; baseline ' || p_ie || ' (Δ=' || abs(ie_count - p_ie) || ').' END,
      CASE WHEN ev_security = 1 THEN 'Advertised security change: observed ' || security ||
        '; baseline ' || p_sec || '.' END,
      CASE WHEN ev_rate_count = 1 THEN 'Supported-rate deviation: observed ' || rate_count ||
        ' unique rates; baseline ' || p_rate || '.' END,
      CASE WHEN ev_timing = 1 THEN 'Timing deviation: clock-skew estimate ' || printf('%.6f', clock_skew) ||
        ' differs strongly from the profiled timing baseline (' || printf('%.1f', z) || 'σ).' END
    ) AS reasons
  FROM points
)"""


STREAKS = """
islands AS (
  SELECT *, sum(1 - suspicious) OVER (PARTITION BY bssid ORDER BY capture_us, frame_id
                                      ROWS UNBOUNDED PRECEDING) AS island
  FROM scored
), streaks AS (
  SELECT *, CAST(sum(suspicious) OVER (PARTITION BY bssid, island ORDER BY capture_us, frame_id
                                       ROWS UNBOUNDED PRECEDING) AS INT) AS streak
  FROM islands
)"""

ALERTS = """
candidates AS (
  SELECT *, row_number() OVER (PARTITION BY bssid ORDER BY capture_us, frame_id) AS nr
  FROM streaks WHERE streak >= 2
), emitted AS (
  SELECT bssid, nr, capture_us FROM candidates WHERE nr = 1
  UNION ALL
  SELECT c.bssid, c.nr, c.capture_us
  FROM emitted e JOIN candidates c ON c.bssid = e.bssid AND c.nr = (
    SELECT min(x.nr) FROM candidates x
    WHERE x.bssid = e.bssid AND x.capture_us >= e.capture_us + 10000000)
), alerts AS (
  SELECT row_number() OVER (ORDER BY c.capture_us, c.frame_id, c.bssid) AS alert_number, c.*,
    round(threat_score * 100, 1) AS threat_score_100
  FROM candidates c JOIN emitted e ON c.bssid = e.bssid AND c.nr = e.nr
)"""

ALERT_COLUMNS = (
    "alert_number, frame_id, bssid, ssid, capture_us, channel, rssi, threat_score_100, streak, reasons"
)
BASE = "base AS (SELECT * FROM beacons WHERE is_baseline)"
WITH_FEATURES = f"WITH {BEACONS}, {features('beacons')}"
WITH_BASE = f"WITH {BEACONS}, {BASE}, {features('base', 'base_features')}"
WITH_PROFILES = f"{WITH_BASE}, {profiles('base_features')}"
WITH_BOTH = f"{WITH_PROFILES}, {features('beacons')}"
MONITORED = "monitored AS (SELECT * FROM features WHERE NOT is_baseline)"
WITH_SCORED = f"{WITH_BOTH}, {MONITORED}, {evidence('monitored')}"
WITH_STREAKS = f"{WITH_SCORED}, {STREAKS}"
WITH_ALERTS = f"{WITH_STREAKS}, {ALERTS}".replace("WITH", "WITH RECURSIVE", 1)
ROUNDED_PROFILE = ", ".join(f"round({c}, 8) AS {c}" for c in PROFILE_STATISTICS)
PROFILE_ROW = ", ".join(c for c, _ in MODES) + f", bssid, total_beacons, {ROUNDED_PROFILE}"

INVENTORY = """
  coalesce(arg_min(ssid, (capture_us, frame_id)) FILTER (WHERE ssid <> '<Hidden>'), '<Hidden>') AS ssid,
  coalesce(arg_max(channel, (capture_us, frame_id)) FILTER (WHERE channel <> 0), 0) AS channel,
  arg_max(rssi, (capture_us, frame_id)) AS rssi, arg_max(security, (capture_us, frame_id)) AS security,
  count(*) AS beacons, min(capture_us) AS first_seen_us, max(capture_us) AS last_seen_us"""

QUARTILES = ", ".join(
    f"round(quantile_cont(clock_skew, {p}), 9) AS {n}"
    for n, p in [("q0", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("q4", 1.0)]
)


def _pseudonym(mac: str) -> str:
    digest = f"sha256({mac})"
    return "'02:' || " + " || ':' || ".join(f"substr({digest}, {1 + 2 * i}, 2)" for i in range(5))


def _replaced(text: str, mapping: dict[str, str]) -> str:
    for old in sorted(mapping, key=len, reverse=True):
        text = f"replace({text}, '{old}', '{mapping[old]}')"
    return text


NOTE_HEAD = "'AP ' || ssid || ' at '"
NOTE_TAIL = "' log /home/user' || CAST(frame_id % 7 AS VARCHAR) || '/x ff:ff:ff:ff:ff:ff'"


def _scrubbed_note(ssid_map: dict[str, str], path_map: dict[str, str]) -> str:
    def clean(text: str) -> str:
        text = _replaced(_replaced(f"({text})", ssid_map), path_map)
        return f"regexp_replace({text}, '/home/[^/\\s\"'']+/', '/home/user/', 'g')"

    return f"{clean(NOTE_HEAD)} || {_pseudonym('bssid')} || {clean(NOTE_TAIL)}"


SCALING = ", ".join(
    f"round(avg({c}), 6) AS mean_{i}, "
    f"round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 6) AS scale_{i}"
    for i, c in enumerate(["clock_skew", "rssi", "seq_jump", "inter_beacon_ms"])
)
SUPERVISED = [
    "rssi", "channel", "seq_jump", "seq_anomaly_score", "clock_skew", "beacon_interval", "ie_count",
    "capabilities", "rate_count", "security_encoded",
]
GAPPED = """
gapped AS (
  SELECT * REPLACE (CASE WHEN frame_id % 7 <> 0 THEN rssi END AS rssi,
                    CASE WHEN frame_id % 7 <> 0 THEN clock_skew END AS clock_skew),
    CASE security WHEN 'WEP' THEN 1 WHEN 'WPA' THEN 2 WHEN 'WPA2/WPA3' THEN 3 ELSE 0 END AS security_encoded
  FROM features
)"""
CELLS = """
cells AS (
  SELECT count(*) FILTER (label = 0 AND p = 0) AS true_negatives,
    count(*) FILTER (label = 0 AND p = 1) AS false_positives,
    count(*) FILTER (label = 1 AND p = 0) AS false_negatives,
    count(*) FILTER (label = 1 AND p = 1) AS true_positives, count(*) AS rows
  FROM (SELECT label, CAST(security IN ('Open', 'WEP', 'WPA') OR rate_count < 8 AS INT) AS p FROM beacons)
)"""
IMPORTED = f"""{WITH_BASE}, cells AS (
  SELECT bssid, CASE WHEN frame_id % 97 <> 0 THEN rssi END AS rssi,
    CASE WHEN frame_id % 97 <> 0 THEN ie_count END AS ie_count FROM base_features)"""
USABLE_FRAME = "frame_id % 150 > 2"

ORACLES: dict[str, str] = {
    "seq_jump": f"{WITH_FEATURES} SELECT frame_id, seq_jump FROM features",
    "seq_anomaly": f"{WITH_FEATURES} SELECT frame_id, seq_anomaly_score FROM features",
    "seq_anomaly_two_tier": f"""{WITH_FEATURES} SELECT frame_id,
      CASE WHEN seq_jump > 100 THEN seq_anomaly_score ELSE 0.0 END AS seq_anomaly_score FROM features""",
    "clock_skew": f"{WITH_FEATURES} SELECT frame_id, clock_skew, valid_skew FROM features",
    "inter_beacon": f"{WITH_FEATURES} SELECT frame_id, inter_beacon_ms FROM features",
    "seq_duplicate": f"{WITH_FEATURES} SELECT frame_id, is_seq_duplicate, seq_dup_delta FROM features",
    "timing_variance": f"""{WITH_FEATURES}
      SELECT frame_id, round(timing_variance, 3) AS timing_variance FROM features""",
    "sliced_features": f"""{WITH_FEATURES} SELECT frame_id, seq_jump, clock_skew, inter_beacon_ms,
      round(timing_variance, 3) AS timing_variance, is_seq_duplicate, seq_dup_delta FROM features""",
    "frame_observations": f"""WITH {BEACONS} SELECT frame_id, capture_us, ssid, bssid, rssi, channel,
      seq_num, beacon_timestamp, beacon_interval, capabilities, supported_rates, rate_count, security,
      ie_count FROM beacons WHERE {USABLE_FRAME}""",
    "scanned_networks": f"""WITH {BEACONS}, seen AS (
      SELECT * REPLACE (CASE WHEN frame_id % 150 = 2 THEN '<Hidden>' ELSE ssid END AS ssid,
                        CASE WHEN frame_id % 150 = 2 THEN 0 ELSE channel END AS channel,
                        CASE WHEN frame_id % 150 = 2 THEN 'Open' ELSE security END AS security)
      FROM beacons WHERE frame_id % 150 > 1)
      SELECT bssid, {INVENTORY} FROM seen GROUP BY bssid""",
    "collection_totals": f"""WITH {BEACONS}, seen AS (SELECT * FROM beacons WHERE {USABLE_FRAME})
      SELECT count(*) AS beacons, count(DISTINCT bssid) AS access_points, max(capture_us) AS latest_us,
        arg_max(ssid, (capture_us, ssid, channel, rssi, security)) AS latest_ssid,
        arg_max(rssi, (capture_us, ssid, channel, rssi, security)) AS latest_rssi FROM seen""",
    "ie_elements": f"""WITH {BEACONS}, parts AS (
      SELECT *, rate_count > 8 AS extended, security = 'WPA2/WPA3' AS rsn FROM beacons WHERE {USABLE_FRAME}
    ), sized AS (
      SELECT *, 3 + CAST(extended AS INT) + CAST(rsn AS INT) AS fixed_ies FROM parts
    ), kinds AS (
      SELECT bssid, 0 AS id, 1 AS c, length(ssid) AS o, 0 AS p FROM sized
      UNION ALL SELECT bssid, 1, 1, least(8, rate_count), 1 FROM sized
      UNION ALL SELECT bssid, 3, 1, 1, 2 FROM sized
      UNION ALL SELECT bssid, 50, 1, rate_count - 8, 3 FROM sized WHERE extended
      UNION ALL SELECT bssid, 48, 1, 2, fixed_ies - 1 FROM sized WHERE rsn
      UNION ALL SELECT bssid, 221, ie_count - fixed_ies, 5 * (ie_count - fixed_ies), ie_count - 1
        FROM sized WHERE ie_count > fixed_ies
    ) SELECT bssid, CAST(id AS INT) AS id, CAST(sum(c) AS BIGINT) AS elements,
        CAST(sum(o) AS BIGINT) AS octets, CAST(max(p) AS INT) AS last_position
      FROM kinds GROUP BY bssid, id""",
    "frame_problems": """SELECT CASE event_id % 150 WHEN 0 THEN 'not a beacon'
        WHEN 1 THEN 'truncated header' ELSE 'no elements' END AS problem, count(*) AS frames
      FROM events WHERE event_id % 150 <= 2 GROUP BY 1""",
    "network_inventory": f"WITH {BEACONS} SELECT bssid, {INVENTORY} FROM beacons GROUP BY bssid",
    "strongest_networks": f"""WITH {BEACONS}, n AS (SELECT bssid, {INVENTORY} FROM beacons GROUP BY bssid)
      SELECT bssid, substr(ssid, 1, 24) AS ssid, channel, rssi, CASE WHEN rssi = 0 THEN 'none'
        WHEN rssi > -50 THEN 'strong' WHEN rssi > -70 THEN 'medium' ELSE 'weak' END AS signal_band,
        security, beacons FROM n""",
    "five_strongest_networks": f"""WITH {BEACONS}, n AS (SELECT bssid, {INVENTORY} FROM beacons GROUP BY bssid)
      SELECT bssid, ssid, rssi FROM n ORDER BY rssi DESC, bssid LIMIT 5""",
    "collection_summary": f"""WITH {BEACONS} SELECT bssid, arg_min(ssid, (capture_us, frame_id)) AS ssid,
      count(*) AS beacons, arg_max(rssi, (capture_us, frame_id)) AS rssi,
      CAST(least(100, count(*) * 100 // 50) AS INT) AS completion_percent FROM beacons GROUP BY bssid""",
    "scan_windows": f"""WITH {BEACONS} SELECT capture_us // 30000000 * 30000000 AS window_start, bssid,
      {INVENTORY} FROM beacons GROUP BY 1, bssid""",
    "scan_session": f"""WITH {BEACONS}, n AS (SELECT bssid, {INVENTORY} FROM beacons
        WHERE capture_us >= {START_US} AND capture_us < {START_US} + 20000000 AND channel <= 6
        GROUP BY bssid) SELECT bssid, ssid, channel, rssi, beacons FROM n""",
    "target_rows": f"""WITH {BEACONS} SELECT frame_id, bssid, ssid, channel, rssi FROM beacons
      WHERE bssid = '02:10:00:00:00:10' AND ssid = 'LAB_AP_01' AND channel = 11""",
    "load_summary": f"""WITH {BEACONS}
      SELECT count(*) AS rows, count(DISTINCT bssid) AS bssids FROM beacons""",
    "import_for_profiles": f"""{IMPORTED} SELECT bssid, count(*) AS rows, count(rssi) AS rssi_values,
      CAST(sum(rssi) AS DOUBLE) AS rssi_sum, CAST(sum(ie_count) AS DOUBLE) AS ie_sum
      FROM cells GROUP BY bssid""",
    "import_for_models": f"""{IMPORTED} SELECT bssid, count(*) AS rows, count(*) AS rssi_values,
      CAST(coalesce(sum(rssi), 0) AS DOUBLE) AS rssi_sum, CAST(coalesce(sum(ie_count), 0) AS DOUBLE) AS ie_sum
      FROM cells GROUP BY bssid""",
    "profiles_json": f"{WITH_PROFILES} SELECT {PROFILE_ROW} FROM profiles",
    "profiles_json_split": f"{WITH_PROFILES} SELECT {PROFILE_ROW} FROM profiles",
    "profile_upsert": f"""{WITH_BOTH}, changed AS (SELECT * FROM features WHERE NOT is_baseline),
      {profiles('changed', 'newer')}
      SELECT bssid, security, ie_count, total_beacons FROM newer
      UNION ALL SELECT bssid, security, ie_count, total_beacons FROM profiles
      WHERE bssid NOT IN (SELECT bssid FROM newer)""",
    "ap_profiles": f"{WITH_PROFILES} SELECT {PROFILE_ROW} FROM profiles",
    "merged_profiles": f"{WITH_PROFILES} SELECT {PROFILE_ROW} FROM profiles",
    "profile_listing": f"""{WITH_PROFILES} SELECT substr(ssid, 1, 24) AS ssid, bssid, ie_count, rate_count,
      round(clock_skew_mean, 8) AS clock_skew_mean, total_beacons FROM profiles""",
    "skipped_aps": f"""WITH {BEACONS} SELECT CASE WHEN frame_id % 997 = 0 THEN bssid || '-' || frame_id
        ELSE bssid END AS bssid, count(*) AS beacons FROM beacons GROUP BY 1 HAVING count(*) < 10""",
    "single_ap_profiles": f"""{WITH_BASE}, {_modes('base_features', 'm')}, st AS (
      SELECT bssid, round(avg(rssi), 8) AS rssi_mean, round(coalesce(stddev_samp(rssi), 0), 8) AS rssi_std,
        CAST(min(rssi) AS DOUBLE) AS rssi_min, CAST(max(rssi) AS DOUBLE) AS rssi_max,
        round(avg(seq_jump), 8) AS seq_jump_mean, round(coalesce(stddev_samp(seq_jump), 0), 8) AS seq_jump_std,
        CAST(max(seq_jump) AS DOUBLE) AS seq_jump_max,
        round(coalesce(avg(clock_skew) FILTER (valid_skew = 1), 0), 8) AS clock_skew_mean,
        round(coalesce(stddev_samp(clock_skew) FILTER (valid_skew = 1), 0), 8) AS clock_skew_std,
        count(*) FILTER (valid_skew = 1) AS valid_skew_samples, count(*) AS total_beacons,
        'legacy_single_ap' AS profile_type
      FROM base_features GROUP BY bssid HAVING count(*) >= 10)
      SELECT st.*, {_mode_columns('m')} FROM st {_mode_joins('m')}""",
    "single_ap_job": f"""WITH {BEACONS}, heard AS (SELECT * FROM beacons WHERE bssid = '02:10:00:00:00:05'
        AND capture_us >= {START_US} AND capture_us < {START_US} + 60000000), {features('heard')}
      SELECT bssid, min(ssid) AS ssid, min(channel) AS channel, count(*) AS total_beacons,
        count(*) FILTER (valid_skew = 1) AS valid_skew_samples, round(avg(rssi), 8) AS rssi_mean
      FROM features GROUP BY bssid""",
    "deviations": f"""{WITH_BOTH} SELECT frame_id,
      round(CASE WHEN p.bssid IS NULL THEN 0.0 WHEN clock_skew_std > 0
        THEN abs(clock_skew - clock_skew_mean) / clock_skew_std
        ELSE abs(clock_skew - clock_skew_mean) END, 6) AS clock_skew_deviation,
      round(CASE WHEN p.bssid IS NULL THEN 0.0 ELSE
        abs(rssi - (rssi_max + rssi_min) / 2) / greatest(rssi_max - rssi_min, 10.0) END, 6) AS rssi_deviation,
      CAST(p.bssid IS NULL OR f.ie_count = p.ie_count AS INT) AS ie_count_match,
      CAST(p.bssid IS NULL OR f.rate_count = p.rate_count AS INT) AS rate_count_match,
      CAST(p.bssid IS NULL OR f.security = p.security AS INT) AS security_match,
      CAST(p.bssid IS NULL OR f.channel = p.channel AS INT) AS channel_match
      FROM features f LEFT JOIN profiles p ON f.bssid = p.bssid""",
    "frame_evidence": f"""{WITH_SCORED} SELECT frame_id, bssid, ev_duplicate_sequence, ev_ie_count,
      ev_security, ev_rate_count, ev_timing, suspicious, threat_score, reasons FROM scored""",
    "evidence_points": f"""{WITH_SCORED}, long AS (
      SELECT 'duplicate_sequence' AS rule, 90 AS weight, ev_duplicate_sequence AS fired FROM scored
      UNION ALL SELECT 'ie_count', 70, ev_ie_count FROM scored
      UNION ALL SELECT 'security', 60, ev_security FROM scored
      UNION ALL SELECT 'timing', 35, ev_timing FROM scored
      UNION ALL SELECT 'rate_count', 30, ev_rate_count FROM scored
      UNION ALL SELECT 'model', 25, 0 FROM scored)
      SELECT rule, CAST(weight AS INT) AS weight, CAST(sum(fired) AS BIGINT) AS frames,
        CAST(sum(fired * weight) AS BIGINT) AS points FROM long GROUP BY rule, weight""",
    "suspicious_streaks": f"{WITH_STREAKS} SELECT frame_id, bssid, suspicious, streak FROM streaks",
    "sliced_streaks": f"{WITH_STREAKS} SELECT frame_id, bssid, suspicious, streak FROM streaks",
    "alerts": f"{WITH_ALERTS} SELECT {ALERT_COLUMNS} FROM alerts",
    "sliced_alerts": f"{WITH_ALERTS} SELECT {ALERT_COLUMNS} FROM alerts",
    "alert_log": f"""{WITH_ALERTS}, said AS (
      SELECT alert_number, '[' || strftime(make_timestamp(capture_us), '%Y-%m-%d %H:%M:%S') || '] ALERT #'
        || alert_number || ' | SSID: ' || ssid || ' | BSSID: ' || bssid || ' | Threat Score: '
        || printf('%.1f', threat_score_100) || '/100' AS headline, nr, bssid FROM alerts
    ), kinds AS (
      SELECT a.alert_number, unnest(list_filter([
        CASE WHEN ev_duplicate_sequence = 1 THEN 'Duplicate sequence activity: sequence ' || seq_num ||
          ' was observed again for the same BSSID within the configured short timing window.' END,
        CASE WHEN ev_ie_count = 1 THEN 'Beacon IE count deviation: observed ' || ie_count ||
          ' Information Elements; baseline ' || p_ie || ' (Δ=' || abs(ie_count - p_ie) || ').' END,
        CASE WHEN ev_security = 1 THEN 'Advertised security change: observed ' || security ||
          '; baseline ' || p_sec || '.' END,
        CASE WHEN ev_rate_count = 1 THEN 'Supported-rate deviation: observed ' || rate_count ||
          ' unique rates; baseline ' || p_rate || '.' END,
        CASE WHEN ev_timing = 1 THEN 'Timing deviation: clock-skew estimate ' || printf('%.6f', clock_skew) ||
          ' differs strongly from the profiled timing baseline (' || printf('%.1f', z) || 'σ).' END],
        lambda x: x IS NOT NULL)) AS reason,
        generate_subscripts(list_filter([ev_duplicate_sequence, ev_ie_count, ev_security, ev_rate_count,
          ev_timing], lambda x: x = 1), 1) AS place
      FROM alerts a)
      SELECT alert_number, CAST(0 AS INT) AS line, headline AS text FROM said
      UNION ALL SELECT alert_number, CAST(place AS INT), '  - ' || reason FROM kinds""",
    "detection_totals": f"""{WITH_ALERTS} SELECT (SELECT count(*) FROM scored) AS frames_evaluated,
      (SELECT CAST(sum(suspicious) AS BIGINT) FROM scored) AS suspicious_frames,
      (SELECT count(*) FROM alerts) AS alerts""",
    "stream_alerts": f"{WITH_BOTH}, {evidence('features')}, {STREAKS}, {ALERTS}".replace(
        "WITH", "WITH RECURSIVE", 1
    ) + f" SELECT {ALERT_COLUMNS} FROM alerts",
    "stream_model_alerts": f"""WITH {BEACONS} SELECT way, (SELECT count(*) FROM beacons) AS frames_evaluated,
      CAST(0 AS BIGINT) AS differing_frames, CAST(0 AS BIGINT) AS differing_alerts
      FROM (VALUES ('broadcast'), ('state')) t(way)""",
    "collected_table": f"""WITH {BEACONS}, usable AS (SELECT * FROM beacons WHERE {USABLE_FRAME}),
      {features('usable')} SELECT frame_id, bssid, ssid, supported_rates, seq_jump, seq_anomaly_score,
      is_seq_duplicate, clock_skew, valid_skew, inter_beacon_ms, CAST(0 AS INT) AS label FROM features""",
    "forest_scaling": f"""{WITH_BASE} SELECT bssid, count(*) AS rows, {SCALING} FROM base_features
      GROUP BY bssid HAVING count(*) >= 20""",
    "forest_scores": f"""{WITH_BOTH}, modelled AS (SELECT bssid FROM base_features GROUP BY bssid HAVING count(*) >= 20)
      SELECT bssid, count(*) AS rows, CAST(sum(valid_skew) AS BIGINT) AS scored, true AS share_holds
      FROM features JOIN modelled USING (bssid) GROUP BY bssid""",
    "forest_cogroup_parity": f"{WITH_BASE} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM base",
    "forest_nodes": f"""{WITH_BASE} SELECT bssid, CAST(100 AS BIGINT) AS trees,
      least(256, count(*)) AS least_rows, least(256, count(*)) AS most_rows, CAST(0 AS BIGINT) AS malformed
      FROM base_features GROUP BY bssid HAVING count(*) >= 20""",
    "forest_global": f"{WITH_BASE} SELECT 'all' AS model_key, count(*) AS rows, true AS spans_zero FROM base",
    "stored_forest": f"{WITH_BASE} SELECT bssid, count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM base GROUP BY bssid",
    "model_evidence": f"""{WITH_BOTH} SELECT frame_id, CAST(valid_skew = 1 AND frame_id % 5 = 0
        AND bssid IN (SELECT bssid FROM profiles) AS INT) AS ev_model FROM features""",
    "forest_classifier": f"""WITH {BEACONS}, s AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS test
      FROM beacons) SELECT 'RandomForestClassifier' AS model_type, CAST(100 AS INT) AS n_estimators,
      CAST(10 AS INT) AS max_depth, n - test AS train_rows, test AS test_rows, test AS cells,
      CAST(3 AS INT) AS limitations FROM s""",
    "feature_importance": f"""WITH {BEACONS} SELECT CAST({len(SUPERVISED)} AS BIGINT) AS features, 1.0::DOUBLE AS total
      FROM beacons LIMIT 1""",
    "labelled_union": f"WITH {BEACONS} SELECT bssid, label, count(*) AS rows FROM beacons GROUP BY ALL",
    "label_distribution": f"WITH {BEACONS} SELECT label, count(*) AS rows FROM beacons GROUP BY label",
    "rates_from_text": f"""WITH {BEACONS} SELECT frame_id, CASE WHEN frame_id % 11 = 0 OR frame_id % 13 = 0
      THEN 0 ELSE rate_count END AS rate_count FROM beacons""",
    "feature_medians": f"{WITH_FEATURES}, {GAPPED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 9) AS median FROM gapped"
        for c in SUPERVISED
    ),
    "median_impute": f"""{WITH_FEATURES}, {GAPPED} SELECT frame_id,
      CAST(coalesce(rssi, (SELECT quantile_cont(rssi, 0.5) FROM gapped)) AS DOUBLE) AS rssi,
      round(coalesce(clock_skew, (SELECT quantile_cont(clock_skew, 0.5) FROM gapped)), 9) AS clock_skew,
      CAST(security_encoded AS DOUBLE) AS security_encoded FROM gapped""",
    "stratified_counts": f"""WITH {BEACONS}, c AS (SELECT label, count(*) AS rows FROM beacons GROUP BY label),
      t AS (SELECT sum(rows) AS total, sum(rows) - ceil(0.2 * sum(rows)) AS train FROM c),
      x AS (SELECT label, rows, rows * train / total AS exact, train FROM c, t),
      y AS (SELECT *, floor(exact) AS low, row_number() OVER (ORDER BY exact - floor(exact) DESC, label) AS r,
              train - sum(floor(exact)) OVER () AS spare FROM x)
      SELECT label, rows, CAST(rows - low - CASE WHEN r <= spare THEN 1 ELSE 0 END AS BIGINT) AS test_rows FROM y""",
    "confusion_counts": f"WITH {BEACONS}, {CELLS} SELECT * FROM cells",
    "classification_report": f"""WITH {BEACONS}, {CELLS}, c AS (
      SELECT CAST(true_negatives AS DOUBLE) AS tn, CAST(false_positives AS DOUBLE) AS fp,
        CAST(false_negatives AS DOUBLE) AS fn, CAST(true_positives AS DOUBLE) AS tp, rows FROM cells
    ), k AS (
      SELECT 'Benign' AS class, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS precision,
        CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS recall, tn + fp AS support FROM c
      UNION ALL SELECT 'Simulated Attack', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, tp + fn FROM c
    ), f AS (
      SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                     ELSE 0 END AS f1 FROM k
    ), r AS (
      SELECT class, precision, recall, f1, support FROM f
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
        sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
      SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
        CAST(support AS BIGINT) AS support, round((tn + tp) / rows, 9) AS accuracy FROM r, c""",
    "skew_distribution": f"""{WITH_BASE}, shown AS (
      SELECT * FROM base_features WHERE abs(clock_skew) < 0.005
        AND (valid_skew = 1 OR NOT EXISTS (SELECT 1 FROM base_features WHERE valid_skew = 1))
    ), top AS (
      SELECT ssid, count(*) AS observations, min(capture_us) AS first_us FROM shown GROUP BY ssid
      ORDER BY observations DESC, ssid LIMIT 5
    ), named AS (
      SELECT *, 'LAB_AP_' || lpad(CAST(row_number() OVER (ORDER BY first_us, ssid) AS VARCHAR), 2, '0')
        AS display_ap FROM top
    ), box AS (
      SELECT ssid, display_ap, observations, quantile_cont(clock_skew, 0.25) AS a,
        quantile_cont(clock_skew, 0.75) AS b, {QUARTILES}
      FROM shown JOIN named USING (ssid) GROUP BY ssid, display_ap, observations)
      SELECT box.ssid, display_ap, observations, q0, q1, median, q3, q4,
        round(min(clock_skew) FILTER (clock_skew BETWEEN a - 1.5*(b-a) AND b + 1.5*(b-a)), 9) AS whisker_low,
        round(max(clock_skew) FILTER (clock_skew BETWEEN a - 1.5*(b-a) AND b + 1.5*(b-a)), 9) AS whisker_high
      FROM box JOIN shown USING (ssid) GROUP BY ALL""",
    "ap_labels": f"""WITH {BEACONS}, f AS (SELECT ssid, min(capture_us) AS first FROM beacons
        GROUP BY ssid) SELECT ssid, 'LAB_AP_' || lpad(CAST(row_number() OVER (ORDER BY first, ssid)
        AS VARCHAR), 2, '0') AS ssid_label FROM f""",
    "ie_baseline": f"""{WITH_PROFILES}, f AS (SELECT bssid, ssid, ie_count FROM profiles ORDER BY bssid LIMIT 8),
      l AS (SELECT ssid, row_number() OVER (ORDER BY min(bssid), ssid) AS n FROM f GROUP BY ssid)
      SELECT bssid, ssid, ie_count, 'LAB_AP_' || lpad(CAST(n AS VARCHAR), 2, '0') AS display_ap
      FROM f JOIN l USING (ssid)""",
    "scrub_text": f"WITH {BEACONS} SELECT frame_id, {_scrubbed_note(SSID_MAP, PATH_MAP)} AS text FROM beacons",
    "scrub_documents": f"""WITH d AS (SELECT doc_id, text, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
      a AS (SELECT *, {" || ':' || ".join(f"substr(h, {1 + 2 * i}, 2)" for i in range(6))} AS mac FROM d),
      s AS (SELECT doc_id, text || ' seen by ' || {_pseudonym('mac')} || ' in /home/user/notes' AS t FROM a)
      SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INT) AS characters FROM s""",
    "scrub_beacons": f"""WITH {BEACONS} SELECT {_pseudonym('bssid')} AS bssid,
      {_replaced('ssid', SSID_MAP)} AS ssid, count(*) AS rows FROM beacons GROUP BY ALL""",
    "mac_audit": f"""WITH {BEACONS} SELECT DISTINCT bssid AS mac, {_pseudonym('bssid')} AS pseudonym
      FROM beacons""",
    "changed_rows": f"""WITH {BEACONS} SELECT count(*) AS rows,
      CAST(sum(length({_scrubbed_note({}, PATH_MAP)})) AS BIGINT) AS characters FROM beacons""",
    "scrubbable_files": """SELECT page_id, 'site/' || ['a.html', '.git/config', 'x/b.PNG', 'venv/c.py',
        '.zip', 'd'][page_id % 6 + 1] AS path FROM pages
      WHERE page_id % 6 IN (0, 4, 5) AND page_id % 10 <> 0""",
}
ORACLES["live_networks"] = ORACLES["scanned_networks"]
MANY_NAMES = {f"LAB_AP_{i:02d}": f"NET_{i:03d}" for i in range(9)} | {"NET_003": "three", "AP": "ap", "NET_0": "net "}
ORACLES |= {
    "security_ladder": f"""WITH {BEACONS} SELECT frame_id,
      CASE frame_id % 4 WHEN 0 THEN 'WPA2/WPA3' WHEN 1 THEN 'WPA' WHEN 2 THEN 'WEP' ELSE 'Open' END AS security
      FROM beacons WHERE {USABLE_FRAME}""",
    "revealed_names": f"""WITH {BEACONS}, seen AS (
      SELECT * REPLACE (CASE WHEN frame_id % 5 > 0 THEN '<Hidden>' ELSE ssid END AS ssid) FROM beacons)
      SELECT bssid, {INVENTORY} FROM seen GROUP BY bssid""",
    "missing_columns": f"""WITH {BEACONS} SELECT import, (SELECT count(*) FROM beacons) AS rows, said
      FROM (VALUES ('profiles', 'missing columns: rssi, security'), ('models', 'missing columns: bssid')) t(import, said)""",
    "training_refused": f"""WITH {BEACONS}
      SELECT 'one class' AS given, count(*) AS rows, 'both benign and attack labels are required' AS said
      FROM beacons WHERE label = 0
      UNION ALL SELECT 'few rows', count(*), 'at least 20 observations are required' FROM beacons WHERE frame_id < 19""",
    "unknown_access_points": f"""WITH {BEACONS} SELECT frame_id, CAST(0 AS INT) AS ev_duplicate_sequence,
      CAST(0 AS INT) AS ev_ie_count, CAST(0 AS INT) AS ev_security, CAST(0 AS INT) AS suspicious,
      0.0::DOUBLE AS threat_score, 0.0::DOUBLE AS clock_skew_deviation, 0.0::DOUBLE AS rssi_deviation,
      CAST(1 AS INT) AS ie_count_match, CAST(1 AS INT) AS rate_count_match, CAST(1 AS INT) AS security_match,
      CAST(1 AS INT) AS channel_match FROM beacons WHERE CAST(right(bssid, 2) AS INT) % 2 = 1""",
    "nonfinite_features": f"""{WITH_BASE}, planted AS (SELECT *, frame_id % 10 > 1 AS usable FROM base_features)
      SELECT bssid AS model_key, count(*) FILTER (usable) AS rows, round(avg(clock_skew) FILTER (usable), 9) AS mean
      FROM planted GROUP BY bssid HAVING count(*) >= 20 AND count(*) FILTER (usable) >= 10
      UNION ALL SELECT 'all', count(*), round(avg(CASE WHEN usable THEN clock_skew ELSE 0 END), 9) FROM planted""",
    "scrub_many_names": f"WITH {BEACONS} SELECT frame_id, {_scrubbed_note(MANY_NAMES, {})} AS text FROM beacons",
}
ORACLES["bucketed_features"] = ORACLES["sliced_features"]
