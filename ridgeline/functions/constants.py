"""Fixed values of the alert domain: word lists, tables and thresholds that results depend on."""

# Fixed values.
FALCON_SEVERITY = {"informational": 2, "low": 3, "medium": 6, "high": 9, "critical": 10}
SENTINEL_SEVERITY = {"high": 9, "medium": 6, "low": 4, "informational": 2, "info": 2}
UNIT_SEVERITY = {"informational": 0.1, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
HIDDEN_SEVERITY = 5
LABEL_COLUMNS = ("is_incident", "incident_id")
FALCON_COLUMNS = ("alert_id", "timestamp", "source_node", "target_node", "user", "tactic", "technique", "severity", "process", "is_incident", "incident_id")
ENTITY_TYPES = ("ip", "user", "host", "service", "file")

# Fixed values.
ATTACK_KINDS = (
    "initial_access", "credential_access", "failed_login_burst", "execution", "lateral_movement", "privilege_escalation",
    "defense_evasion", "discovery", "collection", "data_exfiltration", "command_and_control", "impact",
)

# Fixed values.
TACTIC_KINDS = {
    "initial access": "initial_access",
    "execution": "execution",
    "persistence": "privilege_escalation",
    "privilege escalation": "privilege_escalation",
    "credential access": "credential_access",
    "lateral movement": "lateral_movement",
    "exfiltration": "data_exfiltration",
}

# Fixed values.
#: Kind -> words of which any, anywhere in an alert's text, gives the tag; in the order in which kinds are told.
KIND_WORDS = {
    "initial_access": ("initial access", "drive-by", "malvertising", "fakeupdates", "phish"),
    "lateral_movement": ("lateral", "remote activity", "impacket", "smb", "wmi"),
    "credential_access": ("credential", "password", "lsass", "dcsync", "phish", "signin", "sign-in"),
    "execution": ("execution", "powershell", "encodedcommand", "command execution", "process creation", "remote command", "script"),
    "data_exfiltration": ("exfil", "exfiltration", "data theft", "downloaded data"),
    "command_and_control": ("c2", "command and control", "command-and-control", "commandandcontrol", "cobalt strike", "beacon", "domain fronting", "callback"),
    "privilege_escalation": ("privilege", "persistence", "scheduler", "service creation", "oauth"),
    "defense_evasion": ("defense evasion", "bypass", "disabled security", "tamper", "obfuscat"),
    "discovery": ("discovery", "enumerat", "reconnaissance", "network scan", "port scan"),
    "collection": ("collection", "email collection", "inbox", "archive mailbox", "mailbox"),
    "impact": ("impact", "ransomware", "shadow copies", "file backups were deleted", "wipe", "encrypted"),
}

# Fixed values.
STAGE_RANK = {
    "initial_access": 10, "credential_access": 20, "execution": 30, "command_and_control": 35, "lateral_movement": 40,
    "privilege_escalation": 50, "defense_evasion": 60, "discovery": 70, "collection": 80, "data_exfiltration": 90, "impact": 100,
}

# Fixed values.
TACTIC_PAIRS = {
    ("Credential Access", "Execution"): "credential_execution",
    ("Credential Access", "Lateral Movement"): "credential_lateral_movement",
    ("Initial Access", "Lateral Movement"): "initial_lateral_movement",
    ("Privilege Escalation", "Exfiltration"): "privilege_exfiltration",
    ("Lateral Movement", "Exfiltration"): "lateral_exfiltration",
}

# Fixed values.
ATTACK_CHAINS = (
    ("Initial Access", "Execution", "Credential Access", "Lateral Movement", "Privilege Escalation", "Exfiltration"),
    ("Initial Access", "Execution", "Persistence", "Credential Access", "Lateral Movement"),
    ("Credential Access", "Execution", "Lateral Movement", "Exfiltration"),
    ("Execution", "Privilege Escalation", "Credential Access", "Lateral Movement", "Exfiltration"),
)

# Fixed values.
#: Name -> stages in order, and the steps between stages that count.
ATTACK_GRAPHS = {
    "credential_lateral_privilege": (
        ("credential_access", "execution", "lateral_movement", "privilege_escalation"),
        (("credential_access", "execution"), ("credential_access", "lateral_movement"), ("execution", "lateral_movement"), ("lateral_movement", "privilege_escalation")),
    ),
    "c2_to_lateral_movement": (
        ("command_and_control", "execution", "lateral_movement"),
        (("command_and_control", "execution"), ("command_and_control", "lateral_movement"), ("execution", "lateral_movement")),
    ),
    "cloud_privilege_exfiltration": (
        ("credential_access", "privilege_escalation", "collection", "data_exfiltration"),
        (("credential_access", "privilege_escalation"), ("privilege_escalation", "collection"), ("collection", "data_exfiltration"), ("privilege_escalation", "data_exfiltration")),
    ),
    "ransomware_impact_chain": (
        ("command_and_control", "execution", "lateral_movement", "impact"),
        (("command_and_control", "execution"), ("execution", "lateral_movement"), ("lateral_movement", "impact"), ("execution", "impact")),
    ),
    "credential_to_exfiltration": (
        ("credential_access", "collection", "data_exfiltration"),
        (("credential_access", "collection"), ("collection", "data_exfiltration"), ("credential_access", "data_exfiltration")),
    ),
}

# Fixed values.
GENERIC_ICS_PHRASES = (
    "new activity detected - cip class", "new activity detected - cip class service", "new port discovery",
    "ethernet/ip cip service request failed", "ethernet/ip encapsulation protocol command", "modbus exception",
    "unauthorized mitsubishi melsec command", "omron fins unauthorized command", "bacnet operation failed", "new asset detected",
)

# Fixed values.
#: Type of a raw entity -> its canonical type and the keys that may hold its value, in order.
RAW_ENTITIES = {
    "account": ("user", ("UserPrincipalName", "Name", "Sid", "AadUserId")),
    "host": ("host", ("HostName", "FQDN", "AadDeviceId", "MdatpDeviceId")),
    "ip": ("ip", ("Address",)),
    "mailbox": ("user", ("MailboxPrimaryAddress",)),
    "mailboxconfiguration": ("user", ("MailboxPrimaryAddress",)),
    "file": ("file", ("Name",)),
    "url": ("service", ("Url",)),
    "cloud-application": ("service", ("Name", "AppId", "OAuthAppId", "ServicePrincipalObjectId")),
    "oauth-application": ("service", ("Name", "AppId", "OAuthAppId", "ServicePrincipalObjectId")),
    "service-principal": ("service", ("Name", "AppId", "OAuthAppId", "ServicePrincipalObjectId")),
    "process": ("service", ("CommandLine", "ProcessId")),
}
EMPTY_ENTITY_VALUES = ("none", "nan", "system", "localsystem")

# Fixed values.
ANSWER_PATTERNS = (
    r"`([^`]+)`",
    r"\b((?:\d{1,3}\.){3}\d{1,3})\b",
    r"(https?://[^\s`'\"]+)",
    r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b",
)
ANSWER_KINDS = (
    (("ip address",), r"(?i)^(?:\d{1,3}\.){3}\d{1,3}$"),
    (("url", "link"), r"(?i)^https?://"),
    (("email", "user", "account"), r"(?i)^[^@\s`]+@[^@\s`]+\.[^@\s`]+$"),
    (("host", "device", "machine"), r"(?i)^[a-zA-Z0-9][a-zA-Z0-9_.-]{1,80}$"),
)

# Fixed values.
#: Role of a nested field -> leaf names that may hold it, best first; and path parts that speak for or against a path.
FIELD_NAMES = {
    "alert_id": ("alert_id", "id", "systemalertid", "alertid"),
    "label": ("label", "verdict", "classification", "ground_truth"),
    "tactic": ("tactic", "mitre_tactic", "attack_tactic"),
    "technique": ("technique", "mitre_technique", "attack_technique"),
    "severity": ("severity", "severityname", "severity_name", "risk_score"),
    "timestamp": ("timestamp", "event_time", "eventcreationtime", "time", "created_at"),
    "host": ("hostname", "host", "host_name", "computer", "device", "machine"),
    "user": ("username", "user", "user_name", "account", "principal"),
    "process": ("process", "process_name", "filename", "file_name", "commandline", "command_line"),
    "ip": ("localip", "remoteip", "ip", "source_ip", "dest_ip", "destination_ip", "src_ip", "dst_ip"),
}
RAW_ROLES = ("host", "user", "process", "ip")
FAVOURED_PARTS = ("rawpayload", "event", "input", "raw_payload")
DISFAVOURED_PARTS = ("feedback", "metadata", "output", "scores", "comment", "verified")
REFINEMENTS = ("strict_entity_continuity", "suppress_generic_ics", "reduce_c2_weight", "require_progression_or_severity_density")
INCIDENT_FOLDERS = ("5", "34", "38", "39", "55", "134", "166", "322")
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LOG_SEPARATOR = "\u2756"
DARPA_PHASES = ("ip_sweep", "sadmind_probe", "sadmind_exploit", "ddos_install", "ddos_launch")
ANSWER_STRIP = ".,;:()[]{}\"'"
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")
