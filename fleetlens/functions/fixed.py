"""Fixed values. They must stay as they are for results to agree; all are only defaults."""

# Counter names of the CPU query, output column -> counter.
CPU_COUNTERS = {
    "checkmate_windows": "Process_CheckmateServer____Processor_Time",
    "checkmate_linux": "Process__Total____Processor_Time_mygeotab",
    "maintenance": "Process__Total____Processor_Time_postgres_maintenance",
    "nodejs": "Process__node____Processor_Time",
    "total": "Processor__Total____Processor_Time",
    "postgres": "Process__Total____Processor_Time_postgres",
}

# Counter names of the memory query, output column -> {counter: divisor to GB}.
MEMORY_COUNTERS = {
    "available": {"Memory___Available_MBytes": 1024},
    "checkmate": {
        "Process_CheckmateServer__Working_Set": 1024**3,
        "Memory___Used_MBytes_mygeotab": 1024,
    },
    "allocated": {
        "Process_CheckmateServer__Private_Bytes": 1024**3,
        "Memory___Available_MBytes_mygeotab": 1024,
    },
    "postgres": {"Memory___Used_MBytes_postgres": 1024},
}

# Machine name contains -> (host prefix, host suffix), first match counts.
HOST_FORMS = {
    "CLOUDHOSTP": ("my", ".example.com"),
    "CLOUDHATT": ("afmfe", ".example.net"),
    "GOV": ("gov", ".example.com"),
    "CLOUDHMIRT": ("mirror", ".example.com"),
    "CLOUDHOSTT": ("support", ".example.com"),
    "CLOUDHOSTB": ("preview", ".example.com"),
}
MACHINE_PREFIX_LENGTH = 10

# Reporting names that stand for a production machine.
ALIAS_PATTERN = "my%_alias"
PRODUCTION_PREFIX = "CLOUDHOSTP"

# API calls left out of the ranking.
EXCLUDED_CALLS = (
    "Authenticate",
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
    "Get<SystemSettings>",
)
TOP_CALLS = 8

# Which query statistics count.
QUERY_USER_PATTERN = "gu_%"
EXCLUDED_QUERY_PATTERNS = (
    "%commit%",
    "%begin%",
    "%discard%",
    "%vacuum%",
    "%pg_database_size%",
    "%pg_stat%",
    "%processlock%",
)
QUERY_KEY_LENGTH = 200
QUERY_LABEL_LENGTH = 50
TOP_QUERIES = 100

# Lag actions and their labels.
LAG_ACTIONS = ("UploaderLagTime", "UploaderFileLengthKB", "UploaderFileCount")
LAG_PATTERN = "DDIS.LagTime%"
LAG_RENAMED = {"UploaderLagTime": "Processing Time"}
LAG_DROPPED_TEXT = "DDIS."

# Release stage lookup.
STAGE_PROJECT_PATTERN = "example-fleet%"
STAGE_METADATA_PATTERN = "%u'releasechannel', u'value': u'stageone{major}%"

# Shown when a server has no version row.
UNKNOWN_VERSION = "X.X.XXXX.XXX"

# Panel number -> title.
PANELS = {
    1: "CPU Plot",
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
    12: "Lag Time Plot - ",
}

# Series names of the panels with a fixed set of series, column -> series.
CPU_SERIES = {
    "total": "TotalCPUMean",
    "checkmate": "CheckmateCPUMean",
    "postgres": "PostgresLinuxCPUMean",
    "nodejs": "NodeJsCPUMean",
}
MEMORY_SERIES = {
    "available": "TotalMemoryMean",
    "checkmate": "CheckmateMemoryMean",
    "postgres": "PostgresMemoryMean",
    "allocated": "AllocatedMemoryMean",
}
BAD_FILES_SERIES = "Total Bad Files"

# Columns of the exported records, attributes of the loaded items.
RECORD_COLUMNS = ("account_id", "permissions", "user_name")
ITEM_KEY = "course_id"
ITEM_TEXTS = ("Firstname", "Lastname", "Sex")

# Probe texts.
REFUSED_TEXT, REFUSED_STATUS = "Connection refused", "REFUSED"
UNRESOLVED_TEXT, UNRESOLVED_STATUS = "Name or service not known", "Does not resolve"
UNKNOWN_STATUS = "Unknown Status"
AUTHENTICATION_STATUS = "Authentication Error. Please check username and password"

# User record responses.
UNAUTHORIZED = "Unauthorized"
USER_NOT_FOUND = "User not found"

# Warehouse column -> column name used by the jobs, per warehouse table.
TABLE_COLUMNS = {
    "Performance": {
        "CollectedDateTimeUTC": "ts", "MachineName": "machine", "Counter": "counter",
        "Value": "value",
    },
    "InstalledApplications": {
        "CollectedDateTimeUTC": "ts", "MachineName": "machine", "NumberLogicalCores": "cores",
    },
    "MyServerInfo": {
        "ServerName": "server", "CheckmateVersion": "version", "StatusDateUTC": "ts",
    },
    "PerformanceTime": {
        "MachineName": "machine", "DateTime": "ts", "Source": "source",
        "Level1Action": "action", "CpuSeconds": "cpu_seconds", "Seconds": "seconds",
    },
    "ApiUsage": {
        "DateTime": "ts", "MachineName": "machine", "CallName": "call", "SizeinKb": "size_kb",
        "Seconds": "seconds",
    },
    "PgStatQuery": {
        "CollectedDateTimeUTC": "ts", "MachineName": "machine", "UserName": "user_name",
        "Query": "query", "TotalTimeMilliseconds": "time_ms", "Calls": "calls",
    },
    "MyServerDatabaseInfo": {
        "ServerName": "server", "Name": "name", "StatusDateUTC": "ts",
        "BadFileCount": "bad_files", "DeviceCount": "devices",
    },
    "PerformanceValue": {
        "DateTime": "ts", "Database": "database", "Action": "action",
        "AverageValue": "average_value",
    },
    "Instances": {"Name": "name", "Project": "project", "metadata": "metadata"},
}
