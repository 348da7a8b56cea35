"""Shared DuckDB SQL fragments for the oracle queries.

The flow view below is the SQL twin of ``sources.flowview.flow_view``; every
oracle query starts from it and re-derives the operator independently.
"""

FLOW_CTE = """
b AS (SELECT event_id, ts, user_id, event_type AS et, value,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
flow AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS "timestamp", event_id AS flow_id,
    CASE WHEN et IN ('error','purchase') THEN 'alert' WHEN et = 'signup' THEN 'dns'
         WHEN et = 'click' THEN 'http' ELSE 'flow' END AS event_type,
    CASE et WHEN 'error' THEN 'TCP' WHEN 'purchase' THEN 'UDP' WHEN 'signup' THEN 'ICMP'
            WHEN 'click' THEN 'TCP' ELSE 'UDP' END AS proto,
    concat('10.0.', CAST(user_id % 16 AS VARCHAR), '.', CAST(user_id % 251 AS VARCHAR)) AS src_ip,
    concat('192.168.10.', CAST(CAST(floor(value) AS INTEGER) % 40 AS VARCHAR)) AS dest_ip,
    CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1024 + event_id % 50000 END AS INTEGER) AS src_port,
    CAST(CASE k WHEN 99 THEN 443 WHEN 98 THEN 123 ELSE k END AS INTEGER) AS dest_port,
    CAST(floor(value) AS INTEGER) AS packet_length,
    CAST(CASE WHEN et = 'error' THEN 1 + event_id % 3 ELSE 0 END AS INTEGER) AS alert_severity,
    CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'A' END AS tcp_flags_tc,
    true AS training_mode,
    CASE WHEN value > 150 OR event_id % 37 = 0 THEN 'anomaly' ELSE 'normal' END AS training_label,
    CASE WHEN event_id % 5 < 3 THEN 'session-a' ELSE 'session-b' END AS training_session,
    round(0.15::DOUBLE - value / 1000, 6) + (event_id % 7) * 0.01::DOUBLE AS anomaly_score
  FROM b),
scored AS (
  SELECT *, CASE WHEN anomaly_score < 0 THEN -1 ELSE 1 END AS prediction FROM flow)
"""


def with_flow(body: str, extra_ctes: str = "") -> str:
    """``WITH <flow view>[, extra] <body>``."""
    ctes = FLOW_CTE.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


def fmt2(x: str) -> str:
    """Spark's ``format_string('%.2f', x)``: HALF_UP on the shortest decimal
    text of the double."""
    r = f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,30)), 2)"
    # Java keeps the sign of a negative value that rounds to zero: -0.00
    return f"(CASE WHEN ({x}) < 0 AND {r} = 0 THEN '-' ELSE '' END || printf('%.2f', {r}))"


def sha_mod(text: str, modulus: int, base: int = 0) -> str:
    """``base + int(sha256(text), 16) % modulus`` via 8 chunks of 32 bits."""
    acc = "0::BIGINT"
    for i in range(8):
        chunk = f"CAST(('0x' || substr(sha256({text}), {8 * i + 1}, 8)) AS BIGINT)"
        acc = f"(({acc}) * 4294967296 + {chunk}) % {modulus}"
    return f"({base} + {acc})"
