"""Word lists of the matching rules. Results depend on each entry."""

PREDICATE_SYNONYMS = [
    "port listen_port server_port http_port service_port",
    "max_users concurrent_users max_connections user_limit capacity",
    "jwt_ttl token_expiry token_ttl token_expiration session_timeout timeout timeout_ms",
    "db_engine database_type database_engine db_type database db_backend",
    "db_version database_version database_db_version db_ver",
    "node_version node nodejs_version node_ver runtime_node_version",
    "memory ram min_ram minimum_ram min_memory",
    "max_memory max_ram memory_limit memory_max",
    "cpu cores min_cpu cpu_cores",
    "host hostname bind_host bind_address server_host ip ip_address",
    "ssl_enabled tls_enabled enable_ssl disable_ssl ssl tls",
    "log_level logging_level level",
]
ORTHOGONAL = [
    ("host hostname bind_host bind_address ip ip_address server_host", "port listen_port server_port http_port service_port"),
    ("min_memory min_ram minimum_ram min_cpu min_connections", "max_memory max_ram memory_limit max_cpu max_connections max_users"),
    ("user username db_user db_username", "pass password db_password secret token"),
]
SYSTEM_PREDICATES = (
    "port listen_port server_port http_port service_port node_version node nodejs_version node_ver python_version python python_ver memory ram min_ram "
    "minimum_ram min_memory memory_limit cpu cores min_cpu cpu_cores db_engine database_type database_engine db_type database db_backend jwt_ttl token_expiry "
    "session_timeout timeout timeout_ms max_connections max_users concurrent_users tls_enabled ssl_enabled cluster_region environment version license"
)
GENERIC_SUBJECTS = "default system app application service workspace spec unknown website global infrastructure"
GENERIC_EXTENSIONS = "md txt json yaml yml docx csv pdf ts js html eml"
DOCUMENT_WORDS = "spec specification manifest architecture blueprint directive guide config configuration readme deployment"
WRAPPERS = "runtime spec config configuration settings env metadata properties parameters"
ALIASES = [
    "api api-server backend api_service core-api",
    "frontend web ui client web-app webapp",
    "gateway api-gateway platform-gateway-service ingress",
    "auth authentication auth-service idp identity",
    "db database postgres postgresql mysql sqlite",
]
NOUN_SUFFIXES = "service server daemon app application client pkg package"
AFFIRMATIVE = "true yes 1 enabled active on success passed healthy ready up ok"
NEGATIVE = "false no 0 disabled inactive off failed failing unhealthy down"
TRUE_WORDS = "true yes 1 enabled active on"
FALSE_WORDS = "false no 0 disabled inactive off"
CURRENCIES = [("₹", "INR"), ("INR", "INR"), ("$", "USD"), ("USD", "USD"), ("€", "EUR"), ("EUR", "EUR"), ("£", "GBP"), ("GBP", "GBP"), ("¥", "JPY"), ("JPY", "JPY"), ("CAD", "CAD"), ("AUD", "AUD")]
UNITS = [
    ("b bytes byte", 1.0, "bytes", "B"),
    ("kb k kib ki", 1024.0, "bytes", "KB"),
    ("mb mib mi", 1024.0**2, "bytes", "MB"),
    ("gb g gib gi", 1024.0**3, "bytes", "GB"),
    ("tb t tib ti", 1024.0**4, "bytes", "TB"),
    ("ms millisecond milliseconds", 1.0, "ms", "ms"),
    ("s sec second seconds", 1000.0, "ms", "s"),
    ("m min minute minutes", 60_000.0, "ms", "min"),
    ("h hr hour hours", 3_600_000.0, "ms", "h"),
    ("d day days", 86_400_000.0, "ms", "d"),
]
ENVIRONMENTS = [("prod production live prd", "production"), ("dev development local", "development"), ("stage staging stg", "staging"), ("test testing qa uat ci", "testing"), ("doc docs documentation", "documentation"), ("deploy deployment", "deployment")]
CONCRETE_ENVIRONMENTS = "development staging testing production deployment ci"
GENERIC_TYPES = ("configuration", "string", "requirement", "policy", "")
SPECIFIC_TYPES = ("version", "quantity", "date", "price", "status", "address")
# contradiction type: value types, substrings of the predicate
TYPE_RULES = [
    ("VERSION_MISMATCH", "version", "version release"),
    ("DATE_MISMATCH", "date", "date deadline expires"),
    ("STATUS_MISMATCH", "status", "status state phase condition"),
    ("QUANTITY_MISMATCH", "quantity number", "count quantity limit capacity quota"),
    ("POLICY_MISMATCH", "policy", "policy rule permission access auth security"),
    ("EXISTENCE_MISMATCH", "", "exists deleted presence available"),
    ("CONFIGURATION_MISMATCH", "configuration", "config setting parameter port host"),
    ("REQUIREMENT_MISMATCH", "requirement", "require need prerequisite"),
    ("TEMPORAL_MISMATCH", "", "duration interval period"),
    ("ENTITY_MISMATCH", "", "owner assignee author lead entity"),
]
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2}
ROLE_WEIGHTS = {"authoritative": 1.0, "deployment": 0.95, "configuration": 0.9, "specification": 0.75, "documentation": 0.55, "generated": 0.45, "example": 0.25, "historical": 0.15}
