"""The same results in DuckDB SQL, written from the meaning of the jobs, not from their plans."""

from __future__ import annotations

from fleetlens.plans.bindings import (
    AS_OF, BASE_URL, COUNTERS, EXPECTED_CUSTOMER, EXPECTED_ITEMS, HOSTS, MACHINES, REPORTED, TOKEN,
)

TODAY = AS_OF.strftime("%Y%m%d")

# Written out once more, so that a wrong default in the library shows as a difference.
ALIAS_PATTERN = "my%_alias"
AUTHENTICATION_STATUS = "Authentication Error. Please check username and password"
CPU_COUNTERS = {"checkmate_windows": "Process_CheckmateServer____Processor_Time",
 "checkmate_linux": "Process__Total____Processor_Time_mygeotab",
 "maintenance": "Process__Total____Processor_Time_postgres_maintenance",
 "nodejs": "Process__node____Processor_Time",
 "total": "Processor__Total____Processor_Time",
 "postgres": "Process__Total____Processor_Time_postgres"}
EXCLUDED_CALLS = ("Authenticate",
 "DatabaseExists",
 "GetVersion",
 "Subscribe",
 "GetServerInfo",
 "GetSystemTimeUTC",
 "Unsubscribe",
 "TraceText",
 "GetXMLServerSettings",
 "AuthenticateSaml",
 "GetSystemTimeUtc",
 "Get<SystemSettings>")
EXCLUDED_QUERY_PATTERNS = ("%commit%", "%begin%", "%discard%", "%vacuum%", "%pg_database_size%", "%pg_stat%", "%processlock%")
LAG_ACTIONS = ("UploaderLagTime", "UploaderFileLengthKB", "UploaderFileCount")
LAG_DROPPED_TEXT = "DDIS."
LAG_PATTERN = "DDIS.LagTime%"
MEMORY_COUNTERS = {"available": {"Memory___Available_MBytes": 1024},
 "checkmate": {"Process_CheckmateServer__Working_Set": 1073741824, "Memory___Used_MBytes_mygeotab": 1024},
 "allocated": {"Process_CheckmateServer__Private_Bytes": 1073741824,
               "Memory___Available_MBytes_mygeotab": 1024},
 "postgres": {"Memory___Used_MBytes_postgres": 1024}}
PANELS = {1: "CPU Plot",
 2: "Memory Plot",
 3: "CPU Seconds Plot",
 4: "Actual Seconds Plot",
 5: "API Call Volume Plot",
 6: "API Call Size Plot",
 7: "API Call Time Plot",
 8: "Query Volume Plot",
 9: "Sec Per Query Plot",
 10: "Total Query Time Plot",
 11: "Bad File Count",
 12: "Lag Time Plot - "}
PRODUCTION_PREFIX = "CLOUDHOSTP"
QUERY_KEY_LENGTH = 200
QUERY_LABEL_LENGTH = 50
QUERY_USER_PATTERN = "gu_%"
REFUSED_STATUS = "REFUSED"
REFUSED_TEXT = "Connection refused"
STAGE_PROJECT_PATTERN = "example-fleet%"
TOP_CALLS = 8
TOP_QUERIES = 100
UNKNOWN_STATUS = "Unknown Status"
UNKNOWN_VERSION = "X.X.XXXX.XXX"
UNRESOLVED_STATUS = "Does not resolve"
UNRESOLVED_TEXT = "Name or service not known"
USER_NOT_FOUND = "User not found"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _pick(values, index: str) -> str:
    return f"{_list(values)}[CAST(1 + ({index}) % {len(values)} AS INTEGER)]"


def _folded(day: str, hour: str, minute: str) -> str:
    return (
        f"TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(date_diff('day', DATE '1995-01-01', CAST({day} AS DATE)) % 30 AS INTEGER))"
        f" + to_hours({hour}) + to_minutes({minute})"
    )


LINE_TIME = _folded("l_shipdate", "l_orderkey % 24", "l_linenumber")
ORDER_TIME = _folded("o_orderdate", "o_orderkey % 24", "0")

# Inputs derived from the test tables.
INPUTS = {
    "performance": f"""
        SELECT date_trunc('hour', ts) AS ts,
          CASE WHEN event_id % 5 = 0 THEN lower({_pick(MACHINES, 'user_id')}) ELSE {_pick(MACHINES, 'user_id')} END AS machine,
          {_pick(COUNTERS, 'event_id + user_id')} AS counter, CAST(value AS DECIMAL(18,4)) AS value
        FROM events""",
    "installed_applications": f"""
        SELECT ts, CASE WHEN user_id % 8 = 0 THEN 'CLOUDHOSTP98' WHEN event_id % 3 = 0 THEN lower({_pick(MACHINES, 'user_id')})
            ELSE {_pick(MACHINES, 'user_id')} END AS machine,
          CAST(CASE WHEN user_id % 8 = 1 THEN 2 * (1 + event_id % 2) ELSE 1 + user_id % 8 END AS VARCHAR) AS cores
        FROM events""",
    "server_info": f"""
        SELECT {_pick(HOSTS, 'o_custkey')} AS server, o_orderpriority || '.' || o_orderstatus AS version,
          {ORDER_TIME} AS ts FROM orders""",
    "performance_time": f"""
        SELECT CASE WHEN l_orderkey % 2 = 0 THEN {_pick(REPORTED, 'l_suppkey')} ELSE {_pick(MACHINES, 'l_suppkey')} END AS machine,
          {LINE_TIME} AS ts, l_returnflag AS source,
          CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN '' ELSE l_linestatus END AS action,
          CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(l_discount AS DECIMAL(4,2)) - 0.05) AS cpu_seconds,
          CAST(l_quantity AS DECIMAL(14,2)) * (CAST(l_tax AS DECIMAL(4,2)) - 0.04) AS seconds
        FROM lineitem""",
    "api_usage": f"""
        SELECT {_pick(REPORTED, 'l_suppkey')} AS machine, {LINE_TIME} AS ts,
          CASE p_brand WHEN 'Brand#1' THEN 'Authenticate' WHEN 'Brand#2' THEN 'GetVersion'
            WHEN 'Brand#3' THEN 'Get<SystemSettings>' ELSE p_brand END AS call,
          CAST(l_quantity AS DECIMAL(18,4)) AS size_kb, CAST(l_extendedprice AS DECIMAL(18,4)) AS seconds
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "query_statistics": f"""
        SELECT ts, {_pick(MACHINES, 'user_id')} AS machine,
          CASE event_id % 5 WHEN 0 THEN 'gu' WHEN 1 THEN 'pg_user' ELSE 'gu_' || user_id END AS user_name,
          CASE event_id % 13 WHEN 0 THEN 'COMMIT ' WHEN 1 THEN 'Vacuum ' ELSE 'SELECT ' END
            || event_type || ' FROM ' || props || repeat(' x', 120) || event_id AS query,
          CAST(value AS DECIMAL(18,4)) AS time_ms, 1 + event_id % 7 AS calls
        FROM events""",
    "database_info": f"""
        SELECT {_pick(HOSTS, 'l_suppkey')} AS server, 'DB' || (l_partkey % 50) AS name, {LINE_TIME} AS ts,
          CAST(l_quantity AS BIGINT) AS devices, CAST(l_linenumber AS BIGINT) AS bad_files
        FROM lineitem""",
    "performance_value": """
        SELECT ts, 'dB' || (user_id % 50) AS database,
          CASE event_type WHEN 'click' THEN 'UploaderLagTime' WHEN 'view' THEN 'UploaderFileLengthKB'
            WHEN 'purchase' THEN 'UploaderFileCount' WHEN 'signup' THEN 'DDIS.LagTime.DDIS.' || (event_id % 3)
            ELSE 'Other' END AS action,
          CAST(value AS DECIMAL(18,4)) AS average_value
        FROM events""",
    "instances": """
        SELECT 'my' || s_suppkey || '-' || s_nationkey || '-z' AS name,
          'Example-' || CASE s_suppkey % 4 WHEN 0 THEN 'other' ELSE 'Fleet' END || s_nationkey AS project,
          '{u''key'': u''ReleaseChannel'', u''value'': u''' || CASE s_suppkey % 3 WHEN 0 THEN 'StageOne2104'
            WHEN 1 THEN 'stageone2105' ELSE 'final' END || '.1''}' AS metadata,
          CASE WHEN s_suppkey % 5 = 4 THEN '20240129' ELSE '20240130' END AS dt
        FROM supplier""",
    "sheet": """
        SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_custkey * 2 END AS course_id,
          o_orderpriority AS Firstname, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS Lastname,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 's' || (o_orderkey % 3) END AS Sex
        FROM orders""",
    "quality_items": """
        SELECT CAST(p_partkey AS VARCHAR) AS id,
          CASE p_brand WHEN 'Brand#3' THEN NULL WHEN 'Brand#4' THEN '' WHEN 'Brand#5' THEN ' ' ELSE p_name END AS name
        FROM part""",
    "commands": f"""
        SELECT event_id AS seq,
          CASE WHEN event_id % 17 = 0 THEN 'wrong' WHEN event_id % 19 = 0 THEN NULL ELSE '{TOKEN}' END AS token,
          CASE WHEN event_id % 997 = 0 THEN 'rename' WHEN event_type = 'signup' THEN 'create'
            WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op,
          CASE WHEN event_type = 'signup' OR event_id % 31 = 0 THEN NULL ELSE user_id * 13 + event_id % 13 END AS user_id,
          CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'user' || event_id END AS username,
          CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'pw' || (event_id % 100) END AS password
        FROM events""",
    "json_items": """
        SELECT CASE event_id % 50 WHEN 7 THEN '{"id": ' WHEN 8 THEN '[1, 2]' WHEN 9 THEN NULL WHEN 10 THEN '{}' WHEN 11 THEN '5' ELSE
          '{"id": "' || event_id || '", "value": ' || user_id || '.5, "kind": '
          || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'null' ELSE '[1]' END
          || CASE WHEN event_id % 10 = 0 THEN ', "name": "' || event_type || '"' ELSE ', "extra": {}' END
          || ', ' || substr(props, 2) END AS item
        FROM events""",
    "probe_outputs": """
        SELECT s_name AS src, n_name AS dst, port_order, port,
          CASE (s_suppkey * 7 + n_nationkey * 3 + port_order) % 5
            WHEN 0 THEN 'bash: connect: Connection refused' || chr(10) || '1'
            WHEN 1 THEN 'bash: Name or service not known' || chr(10) || '1'
            WHEN 2 THEN ' slow ' || chr(10) || ' 124 ' || chr(10) WHEN 3 THEN '  0 '
            ELSE 'up' || chr(10) || '0' || chr(10) END AS output,
          CASE (s_suppkey + n_nationkey * 5 + port_order * 11) % 13 WHEN 0 THEN 'name' WHEN 1 THEN 'auth' END AS error
        FROM supplier, nation, (VALUES (0, '22'), (1, '80'), (2, '443')) p(port_order, port)""",
}


def _sum_of(counter: str) -> str:
    return f"CAST(sum(CASE WHEN counter = '{counter}' THEN value ELSE 0 END) AS DOUBLE)"


def _memory(name: str) -> str:
    return " + ".join(f"{_sum_of(c)} / {d}" for c, d in MEMORY_COUNTERS[name].items())


_C = {name: _sum_of(counter) for name, counter in CPU_COUNTERS.items()}
_DIGITS = "regexp_replace(machine, '[^0-9]+', '', 'g')"
_QUERY_OK = " AND ".join(f"lower(query) NOT LIKE '{p}'" for p in EXCLUDED_QUERY_PATTERNS)

# Intermediate results, each from inputs or from earlier ones.
STEPS = {
    "latest_cores": """
        SELECT machine, CAST(cores AS DOUBLE) AS cores, ts FROM (
          SELECT *, row_number() OVER (PARTITION BY lower(machine), cores ORDER BY ts DESC, machine DESC) AS rn FROM installed_applications)
        WHERE rn = 1""",
    "cpu": f"""
        SELECT p.machine, p.ts, c.cores,
          {_C['checkmate_windows']} / c.cores + {_C['checkmate_linux']} AS checkmate,
          {_C['maintenance']} AS maintenance, {_C['nodejs']} / c.cores AS nodejs,
          {_C['total']} AS total, {_C['postgres']} AS postgres
        FROM performance p LEFT JOIN latest_cores c ON p.machine = c.machine
        GROUP BY p.machine, p.ts, c.cores""",
    "cpu_grid": """
        SELECT key, unnest(generate_series(first, last, INTERVAL 5 MINUTE)) AS bucket FROM (
          SELECT lower(machine) AS key, min(ts) AS first, max(ts) AS last FROM performance GROUP BY 1)""",
    "cpu_buckets": """
        SELECT key AS machine, bucket, avg(checkmate) AS checkmate, avg(maintenance) AS maintenance,
          avg(nodejs) AS nodejs, avg(total) AS total, avg(postgres) AS postgres
        FROM cpu_grid JOIN cpu ON lower(cpu.machine) = key AND ts >= bucket AND ts < bucket + INTERVAL 5 MINUTE
        GROUP BY key, bucket""",
    "memory": f"""
        SELECT lower(machine) AS machine, ts, {_memory('available')} AS available, {_memory('checkmate')} AS checkmate,
          {_memory('allocated')} AS allocated, {_memory('postgres')} AS postgres
        FROM performance GROUP BY 1, 2""",
    "first_seen": "SELECT server, version, min(ts) AS first_seen FROM server_info GROUP BY server, version",
    "newest_version": """
        SELECT server, version, first_seen FROM (
          SELECT *, row_number() OVER (PARTITION BY server ORDER BY first_seen DESC, version) AS rn FROM first_seen)
        WHERE rn = 1""",
    "names": f"""
        SELECT DISTINCT machine, CASE WHEN machine LIKE '{ALIAS_PATTERN}'
          THEN '{PRODUCTION_PREFIX}' || {_DIGITS} ELSE machine END AS entry
        FROM performance_time WHERE strftime(ts, '%Y%m%d') = '{TODAY}'""",
    "entries": "SELECT DISTINCT lower(machine) AS reported, lower(entry) AS entry FROM names",
    "seconds": """
        SELECT entry AS machine, ts, source,
          CASE WHEN sum(cpu_seconds) < 0 THEN 0 ELSE CAST(sum(cpu_seconds) AS DOUBLE) END AS cpu_seconds,
          CASE WHEN sum(seconds) < 0 THEN 0 ELSE CAST(sum(seconds) AS DOUBLE) END AS actual_seconds
        FROM performance_time JOIN entries ON lower(machine) = reported
        WHERE action IS NOT NULL AND action <> '' GROUP BY entry, ts, source""",
    "top_calls": f"""
        SELECT entry, call FROM (
          SELECT entry, call, row_number() OVER (PARTITION BY entry ORDER BY count(*) DESC, call) AS rn
          FROM api_usage JOIN entries ON lower(machine) = reported
          WHERE call NOT IN {_in(EXCLUDED_CALLS)} GROUP BY entry, call)
        WHERE rn <= {TOP_CALLS}""",
    "calls": """
        SELECT e.entry AS machine, date_trunc('minute', ts) AS minute, u.call,
          CAST(sum(size_kb) AS DOUBLE) AS total_size, CAST(sum(seconds) AS DOUBLE) AS total_secs, count(*) AS calls
        FROM api_usage u JOIN entries e ON lower(u.machine) = e.reported
        WHERE (e.entry, u.call) IN (SELECT (entry, call) FROM top_calls) GROUP BY 1, 2, 3""",
    "totals": f"""
        SELECT lower(machine) AS machine, date_trunc('hour', ts) AS hour,
          substr(lower(query), 1, {QUERY_KEY_LENGTH}) AS key,
          CAST(sum(time_ms) AS DOUBLE) AS total_time_ms, CAST(sum(calls) AS BIGINT) AS total_calls
        FROM query_statistics WHERE user_name LIKE '{QUERY_USER_PATTERN}' AND {_QUERY_OK}
        GROUP BY 1, 2, 3""",
    "top_queries": f"""
        SELECT machine, key FROM (
          SELECT *, row_number() OVER (PARTITION BY machine ORDER BY total_time_ms DESC, key, hour) AS rn
          FROM totals WHERE total_calls > 1)
        WHERE rn <= {TOP_QUERIES}""",
    "queries": f"""
        SELECT t.machine, t.hour, substr(lower(t.key), 1, {QUERY_LABEL_LENGTH}) AS short_query,
          t.total_time_ms, t.total_calls, (t.total_time_ms / 1000) / nullif(t.total_calls, 0) AS sec_per_call
        FROM totals t RIGHT JOIN top_queries q ON t.machine = q.machine AND t.key = q.key""",
    "bad_files": """
        SELECT server, ts, CAST(sum(bad_files) AS BIGINT) AS total_bad_files FROM database_info GROUP BY server, ts""",
    "biggest": f"""
        SELECT server, database, devices FROM (
          SELECT server, lower(name) AS database, devices,
            row_number() OVER (PARTITION BY server ORDER BY devices DESC, lower(name)) AS pos
          FROM (SELECT *, rank() OVER (PARTITION BY name, server ORDER BY ts DESC) AS rn FROM database_info
            WHERE strftime(ts, '%Y%m%d') = '{TODAY}')
          WHERE rn = 1)
        WHERE pos = 1""",
    "lag": f"""
        SELECT ts, database, CASE WHEN action = 'UploaderLagTime' THEN 'Processing Time'
          ELSE replace(action, '{LAG_DROPPED_TEXT}', '') END AS action, average_value
        FROM performance_value WHERE action IN {_in(LAG_ACTIONS)} OR action LIKE '{LAG_PATTERN}'""",
    "big_lag": """
        SELECT b.server, b.database, l.ts, l.action, l.average_value
        FROM lag l JOIN biggest b ON lower(l.database) = b.database""",
    # Panels.
    "machines": "SELECT unnest({listed}) AS machine, unnest({hosts}) AS host".format(
        listed=_list([*("cloudhmirt13" if m == "CLOUDHMIRT13" else m for m in MACHINES), "CLOUDHOSTP99"]),
        # A lower-case name matches no host form.
        hosts=_list([*HOSTS, "my99.example.com"]).replace("'mirror13.example.com'", "NULL"),
    ),
    "by_label": """
        SELECT machine, hour, short_query, CAST(sum(total_calls) AS DOUBLE) AS total_calls,
          sum(sec_per_call) AS sec_per_call, sum(total_time_ms) AS total_time_ms
        FROM queries GROUP BY 1, 2, 3""",
    "keyed": """
        SELECT machine, 1 AS panel_no, 'TotalCPUMean' AS series, bucket AS x, total AS y FROM cpu_buckets
        UNION ALL SELECT machine, 1, 'CheckmateCPUMean', bucket, checkmate FROM cpu_buckets
        UNION ALL SELECT machine, 1, 'PostgresLinuxCPUMean', bucket, postgres FROM cpu_buckets
        UNION ALL SELECT machine, 1, 'NodeJsCPUMean', bucket, nodejs FROM cpu_buckets
        UNION ALL SELECT machine, 2, 'TotalMemoryMean', ts, available FROM memory
        UNION ALL SELECT machine, 2, 'CheckmateMemoryMean', ts, checkmate FROM memory
        UNION ALL SELECT machine, 2, 'PostgresMemoryMean', ts, postgres FROM memory
        UNION ALL SELECT machine, 2, 'AllocatedMemoryMean', ts, allocated FROM memory
        UNION ALL SELECT machine, 3, source, ts, cpu_seconds FROM seconds
        UNION ALL SELECT machine, 4, source, ts, actual_seconds FROM seconds
        UNION ALL SELECT machine, 5, call, minute, calls FROM calls
        UNION ALL SELECT machine, 6, call, minute, total_size FROM calls
        UNION ALL SELECT machine, 7, call, minute, total_secs FROM calls
        UNION ALL SELECT machine, 8, short_query, hour, total_calls FROM by_label
        UNION ALL SELECT machine, 9, short_query, hour, sec_per_call FROM by_label
        UNION ALL SELECT machine, 10, short_query, hour, total_time_ms FROM by_label""",
    "hosted": """
        SELECT server, 11 AS panel_no, 'Total Bad Files' AS series, ts AS x, CAST(total_bad_files AS DOUBLE) AS y FROM bad_files
        UNION ALL SELECT server, 12, action, ts, CAST(sum(average_value) AS DOUBLE) FROM big_lag GROUP BY server, action, ts""",
    "points": """
        SELECT m.machine, panel_no, series, x, y FROM keyed k JOIN machines m ON k.machine = lower(m.machine)
        UNION ALL SELECT m.machine, panel_no, series, x, y FROM hosted h JOIN machines m ON h.server = m.host""",
    "ends": """
        SELECT machine, panel_no,
          CASE WHEN panel_no IN (1, 2, 11) THEN 0.0 ELSE min(top) END AS lo,
          CASE WHEN panel_no = 1 THEN 100.0
            WHEN panel_no = 2 THEN max(CASE WHEN series = 'AllocatedMemoryMean' THEN top END) ELSE max(top) END AS hi
        FROM (SELECT machine, panel_no, series, max(y) AS top FROM points GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "panel_titles": "SELECT * FROM (VALUES {}) t(panel_no, title)".format(
        ", ".join(f"({n}, '{t}')" for n, t in PANELS.items())
    ),
    "panels": f"""
        SELECT p.machine, p.panel_no, CASE WHEN p.panel_no = 12 THEN title || coalesce(b.database, '') ELSE title END AS panel,
          kind, series, x, CASE WHEN p.panel_no IN (1, 9) THEN round(y, 9) ELSE y END AS y
        FROM (
          SELECT machine, panel_no, 'series' AS kind, series, x, y FROM points
          UNION ALL
          SELECT e.machine, e.panel_no, 'marker', coalesce(v.version, '{UNKNOWN_VERSION}'), v.first_seen,
            unnest([lo, hi]) FROM ends e JOIN machines m USING (machine) LEFT JOIN newest_version v ON v.server = m.host) p
        JOIN panel_titles t ON p.panel_no = t.panel_no JOIN machines m ON p.machine = m.machine
        LEFT JOIN biggest b ON b.server = m.host""",
    # Records.
    "outcomes": """
        SELECT *, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status FROM (
          SELECT *, CASE WHEN course_id IS NULL THEN 'course_id is missing' WHEN Firstname IS NULL THEN 'Firstname is missing'
            WHEN Lastname IS NULL THEN 'Lastname is missing' WHEN Sex IS NULL THEN 'Sex is missing' END AS reason FROM sheet)""",
    "attributes": """
        SELECT k AS name, CASE json_type(item, '$.' || k) WHEN 'VARCHAR' THEN 'S' WHEN 'BOOLEAN' THEN 'BOOL'
          WHEN 'NULL' THEN 'NULL' WHEN 'ARRAY' THEN 'L' WHEN 'OBJECT' THEN 'M' ELSE 'N' END AS type
        FROM (SELECT item, unnest(json_keys(item)) AS k FROM (
          SELECT item FROM json_items WHERE CASE WHEN json_valid(item) THEN json_type(item) = 'OBJECT' ELSE false END))""",
    "expected": "SELECT * FROM (VALUES {}) t(name, type)".format(", ".join(f"('{n}', '{t}')" for n, t in EXPECTED_ITEMS)),
    # Users.
    "created": f"""
        SELECT row_number() OVER (ORDER BY seq) AS user_id, seq AS created, username, password FROM commands
        WHERE token = '{TOKEN}' AND op = 'create' AND username IS NOT NULL AND password IS NOT NULL""",
    "lives": f"""
        SELECT c.*, (SELECT min(d.seq) FROM commands d WHERE d.token = '{TOKEN}' AND d.op = 'delete'
          AND d.user_id = c.user_id AND d.seq > c.created) AS deleted FROM created c""",
    "states": f"""
        SELECT user_id, username, sha1(username || password) AS password FROM (
          SELECT user_id, seq, username, password, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM (
            SELECT user_id, created AS seq, username, password FROM lives WHERE deleted IS NULL
            UNION ALL
            SELECT u.user_id, u.seq, u.username, u.password FROM commands u JOIN lives l ON u.user_id = l.user_id
            WHERE u.token = '{TOKEN}' AND u.op = 'update' AND u.username IS NOT NULL AND u.password IS NOT NULL
              AND u.seq > l.created AND l.deleted IS NULL))
        WHERE rn = 1""",
    # Probes.
    "probe_rows": f"""
        SELECT src, dst, port_order, CASE WHEN error IS NULL THEN port ELSE 'N/A' END AS port,
          CASE WHEN error = 'name' THEN port || ' is not reachable'
            WHEN error = 'auth' THEN '{AUTHENTICATION_STATUS}'
            WHEN output LIKE '%{REFUSED_TEXT}%' THEN '{REFUSED_STATUS}'
            WHEN output LIKE '%{UNRESOLVED_TEXT}%' THEN '{UNRESOLVED_STATUS}'
            WHEN len(lines) > 1 THEN trim(lines[-1]) ELSE '{UNKNOWN_STATUS}' END AS status
        FROM (SELECT *, string_split(trim(output, ' ' || chr(10)), chr(10)) AS lines FROM probe_outputs) o
        WHERE NOT EXISTS (SELECT 1 FROM probe_outputs e WHERE e.src = o.src AND e.dst = o.dst
          AND e.port_order < o.port_order AND e.error IS NOT NULL)""",
}

_BEFORE = {
    "cpu_buckets": ("performance", "installed_applications", "latest_cores", "cpu", "cpu_grid"),
    "newest_version": ("server_info", "first_seen"),
    "entries": ("performance_time", "names"),
    "seconds": ("entries",),
    "calls": ("entries", "api_usage", "top_calls"),
    "queries": ("query_statistics", "totals", "top_queries"),
    "bad_files": ("database_info",),
    "biggest": ("database_info",),
    "lag": ("performance_value",),
    "big_lag": ("lag", "biggest"),
    "panels": (
        "cpu_buckets", "performance", "memory", "seconds", "calls", "queries", "bad_files", "big_lag",
        "newest_version", "machines", "by_label", "keyed", "hosted", "points", "ends", "panel_titles",
    ),
    "outcomes": ("sheet",),
    "attributes": ("json_items",),
    "states": ("commands", "created", "lives"),
    "probe_rows": ("probe_outputs",),
    "memory": ("performance",),
}


def _with(steps: tuple[str, ...], query: str) -> str:
    """The query after the named steps, each preceded once by those it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for earlier in _BEFORE.get(name, ()):
            add(earlier)
        if name not in order:
            order.append(name)

    for step in steps:
        add(step)
    texts = [f"{name} AS ({(INPUTS | STEPS)[name].strip()})" for name in order]
    return "WITH " + ",\n".join(texts) + "\n" + query


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)


_MEASURES = _rounded("checkmate", "maintenance", "nodejs", "total", "postgres")

SQL = {
    "cpu_usage_buckets": _with(("cpu_buckets",), f"SELECT machine, bucket, {_MEASURES} FROM cpu_buckets"),
    "counter_pivot": _with(
        ("performance", "installed_applications", "latest_cores", "cpu"),
        f"SELECT machine, ts, cores, {_MEASURES} FROM cpu",
    ),
    "latest_cores": _with(("installed_applications", "latest_cores"), "SELECT * FROM latest_cores"),
    "bucket_avg": f"""
        WITH samples AS (SELECT {_pick(MACHINES, 'user_id')} AS machine, ts, value FROM events),
        grid AS (SELECT machine, unnest(generate_series(min(ts), max(ts), INTERVAL 5 MINUTE)) AS bucket
          FROM samples GROUP BY machine)
        SELECT s.machine, bucket, round(avg(value), 9) AS value FROM samples s JOIN grid g
          ON s.machine = g.machine AND ts >= bucket AND ts < bucket + INTERVAL 5 MINUTE GROUP BY 1, 2""",
    "memory_usage": _with(("memory",), "SELECT * FROM memory"),
    "first_seen_versions": _with(("server_info", "first_seen"), "SELECT * FROM first_seen"),
    "latest_version_marker": _with(
        ("newest_version",),
        f"""SELECT h.server, coalesce(v.version, '{UNKNOWN_VERSION}') AS version, v.first_seen AS last_upgrade
        FROM (SELECT unnest({_list([*HOSTS, 'my99.example.com'])}) AS server) h LEFT JOIN newest_version v USING (server)""",
    ),
    "active_name_map": _with(("performance_time", "names"), "SELECT * FROM names"),
    "performance_seconds": _with(("seconds",), "SELECT * FROM seconds"),
    "api_usage_top_calls": _with(("calls",), "SELECT * FROM calls"),
    "query_profile": _with(("queries",), "SELECT * FROM queries"),
    "query_profile_dedup": _with(
        ("queries",),
        f"""SELECT machine, hour, substr(key, 1, {QUERY_LABEL_LENGTH}) AS short_query, total_time_ms, total_calls,
          (total_time_ms / 1000) / nullif(total_calls, 0) AS sec_per_call
        FROM totals WHERE (machine, key) IN (SELECT (machine, key) FROM top_queries)""",
    ),
    "bad_file_count": _with(("bad_files",), "SELECT * FROM bad_files"),
    "biggest_database": _with(("biggest",), "SELECT * FROM biggest"),
    "lag_by_action": _with(
        ("lag",), "SELECT ts, database, action, CAST(average_value AS DOUBLE) AS average_value FROM lag"
    ),
    "lag_of_biggest_database": _with(
        ("big_lag",), "SELECT server, database, ts, action, CAST(average_value AS DOUBLE) AS average_value FROM big_lag"
    ),
    "stage_one_servers": _with(
        ("instances",),
        f"""SELECT '{PRODUCTION_PREFIX}' || substr(split_part(name, '-', 1), 3) AS machine FROM instances
        WHERE dt = '{TODAY}' AND lower(project) LIKE '{STAGE_PROJECT_PATTERN}'
          AND lower(metadata) LIKE '%u''releasechannel'', u''value'': u''stageone2104%'""",
    ),
    "series_pivot": "SELECT date_trunc('hour', ts) AS x, "
    + ", ".join(
        f"CAST(sum(CASE WHEN event_type = '{e}' THEN CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(value AS DECIMAL(18,4)) END END) AS DOUBLE) AS {e}"
        for e in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events WHERE event_id % 41 <> 0 GROUP BY 1",
    "marker_bounds": f"""
        WITH points AS (SELECT {_pick(MACHINES, 'user_id')} AS machine, CAST(1 + event_id % 12 AS INTEGER) AS panel_no,
          CASE WHEN event_type = 'view' THEN 'AllocatedMemoryMean' ELSE event_type END AS series, value AS y FROM events),
        ends AS ({STEPS['ends']})
        SELECT machine, panel_no, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM ends""",
    "health_check_panels": _with(("panels",), "SELECT * FROM panels"),
    "panel_report_write": _with(
        ("panels",),
        f"""SELECT m.machine, '{AS_OF:%Y%m%d-%H%M}-ServerPerformance/machine=' || m.machine AS folder,
          '{BASE_URL}/{AS_OF:%Y%m%d-%H%M}-ServerPerformance/machine=' || m.machine AS url,
          count(p.machine) AS n_rows FROM machines m LEFT JOIN panels p ON p.machine = m.machine GROUP BY m.machine""",
    ),
    "trailing_shards": f"""
        SELECT event_id, ts, strftime(ts, '%Y%m%d') AS dt, value FROM events
        WHERE strftime(ts, '%Y%m%d') BETWEEN strftime(TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY, '%Y%m%d') AND '{TODAY}'""",
    "records_to_csv": """
        SELECT CAST(c_custkey AS VARCHAR) AS account_id,
          CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '["' || c_mktsegment || '","read"]' END AS permissions,
          CASE c_custkey % 5 WHEN 0 THEN c_name || ',b' WHEN 1 THEN 'q"' || c_name
            WHEN 2 THEN ' ' || c_name || ' ' || chr(10) || ' z' WHEN 3 THEN '' ELSE c_name END AS user_name
        FROM customer""",
    "typed_items": _with(
        ("sheet",), "SELECT CAST(course_id AS VARCHAR) AS course_id, Firstname, Lastname, Sex FROM sheet"
    ),
    "keyed_upsert": _with(
        ("outcomes",),
        """SELECT course_id, Firstname, Lastname, Sex FROM (
          SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY seq DESC) AS rn FROM (
            SELECT -1 AS seq, c_custkey AS course_id, c_name AS Firstname, c_mktsegment AS Lastname, 'x' AS Sex FROM customer
            UNION ALL SELECT seq, course_id, Firstname, Lastname, Sex FROM outcomes WHERE status = 'accepted'))
        WHERE rn = 1""",
    ),
    "load_outcomes": _with(
        ("outcomes",),
        """SELECT seq, course_id, status, reason, CASE WHEN reason IS NULL
          THEN 'Course ' || course_id || ' uploaded successfully'
          ELSE 'Error uploading course ' || coalesce(CAST(course_id AS VARCHAR), '') || ': ' || reason END AS message
        FROM outcomes""",
    ),
    "schema_diff": _with(
        ("attributes", "expected"),
        """SELECT e.name, e.type AS expected_type,
          (SELECT string_agg(DISTINCT a.type, ',' ORDER BY a.type) FROM attributes a WHERE a.name = e.name) AS actual_type,
          CASE WHEN EXISTS (SELECT 1 FROM attributes a WHERE a.name = e.name) THEN 'type_mismatch' ELSE 'missing' END AS status
        FROM expected e WHERE NOT EXISTS (SELECT 1 FROM attributes a WHERE a.name = e.name AND a.type = e.type)""",
    ),
    "scanned_schema": _with(("attributes",), """SELECT name, type, count(*) AS n FROM attributes GROUP BY 1, 2
        UNION ALL SELECT NULL, 'rejected', count(*) FROM json_items
        WHERE NOT coalesce(CASE WHEN json_valid(item) THEN json_type(item) = 'OBJECT' ELSE false END, false)"""),
    "schema_evolve": "SELECT *, CAST(NULL AS VARCHAR) AS c_phone, CAST(NULL AS DOUBLE) AS c_rank, "
    "CAST(NULL AS BOOLEAN) AS c_active FROM customer",
    "quality_gate": _with(
        ("quality_items",),
        """SELECT 'id' AS "column", bool_or(id IS NULL OR id = '') AS has_issue,
          count(*) FILTER (WHERE id IS NULL OR id = '') AS n_missing FROM quality_items
        UNION ALL SELECT 'name', bool_or(name IS NULL OR name = ''),
          count(*) FILTER (WHERE name IS NULL OR name = '') FROM quality_items""",
    ),
    "quality_quarantine": _with(
        ("quality_items",),
        """SELECT id, name, 'Item with missing name: {"id":"' || id || '","name":'
          || CASE WHEN name IS NULL THEN 'null' ELSE '""' END || '}' AS message
        FROM quality_items WHERE name IS NULL OR name = ''""",
    ),
    "user_state": _with(("states",), "SELECT * FROM states"),
    "user_lookup": _with(
        ("states",),
        f"""SELECT c_custkey AS user_id, s.username, s.password,
          CASE WHEN s.user_id IS NULL THEN '{USER_NOT_FOUND}' END AS error
        FROM customer LEFT JOIN states s ON c_custkey = s.user_id""",
    ),
    "command_responses": _with(
        ("states",),
        f"""SELECT seq, op, CASE reason WHEN 'Unauthorized' THEN 401 WHEN 'unknown command' THEN 405
            WHEN 'user_id is missing' THEN 500 WHEN 'username or password is missing' THEN 500 ELSE 200 END AS status,
          CASE WHEN reason IS NULL AND op <> 'delete' THEN coalesce(new_id, target) END AS user_id,
          CASE WHEN reason IS NULL AND op <> 'delete' THEN username END AS username,
          CASE WHEN reason IS NULL AND op <> 'delete' THEN sha1(username || password) END AS password, reason AS error
        FROM (
          SELECT c.seq, c.op, c.username, c.password, c.user_id AS target, n.user_id AS new_id,
            CASE WHEN c.token IS NULL OR c.token <> '{TOKEN}' THEN 'Unauthorized'
              WHEN c.op NOT IN ('create', 'update', 'delete') THEN 'unknown command'
              WHEN c.op <> 'create' AND c.user_id IS NULL THEN 'user_id is missing'
              WHEN c.op = 'update' AND (l.user_id IS NULL OR l.created > c.seq OR l.deleted < c.seq) THEN '{USER_NOT_FOUND}'
              WHEN c.op <> 'delete' AND (c.username IS NULL OR c.password IS NULL) THEN 'username or password is missing'
            END AS reason
          FROM commands c LEFT JOIN lives l ON c.user_id = l.user_id LEFT JOIN created n ON n.created = c.seq)""",
    ),
    "probe_matrix": _with(("probe_outputs",), "SELECT src, dst, port_order, port FROM probe_outputs"),
    "probe_status": _with(("probe_rows",), "SELECT * FROM probe_rows"),
    "probe_report": _with(
        ("probe_rows",),
        """SELECT src, dst, port_order, src || '#' || dst || '#' || port || '#' || status AS line,
          'Source host ' || src || ' Dest host ' || dst || ' Port ' || port || ' - ' || status AS sentence FROM probe_rows""",
    ),
}
