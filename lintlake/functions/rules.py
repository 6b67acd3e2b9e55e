"""The built-in rule table.

A rule is one regular expression plus the labels its findings carry.  The
expressions are written without inline flags; ``flags`` lists the ones that
apply (``i`` ignore case, ``s`` dot matches newline).  ``needs`` is our own
addition: lower-case substrings that any matching text must contain (every
group, at least one member each).  They let the scan skip the regular
expression for most files and never change a result.  ``gate`` is the same
idea for shapes that are not literal text.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    agent: str
    category: str
    severity: str
    confidence: str
    flags: str
    pattern: str
    ref_primary: str | None
    ref_secondary: str | None
    description: str
    advice: str
    needs: tuple[tuple[str, ...], ...] = ()
    gate: str | None = None
    suppress: tuple[str, ...] = ()

    @property
    def java_regex(self) -> str:
        """``d`` makes newline the only line terminator, ``U`` the classes and letter case those of Unicode."""
        return f"(?dU{self.flags}){self.pattern}"

    @property
    def has_lookahead(self) -> bool:
        return "(?!" in self.pattern


# Pieces shared by the first groups of all rules.  A scan looks for each piece
# once per file, and for everything else only where a rule's piece occurs.
ANCHORS = (
    "-----", "*", "+", ".get", ".new(", "0.0.0.0", "@", "_", "_by_id", "_code", "_data", "_info", "access", "admin",
    "api", "aws", "card_", "cert_", "console", "create", "cv", "debug", "delete", "echo", "email", "eval", "exec", "eyj",
    "ftp", "grant", "http:", "log", "md5", "models.", "passw", "pickle", "print", "pwd", "query", "random.", "sha1",
    "snowflake_", "ssn", "update", "verify", "where", "write",
)


def anchor_of(word: str) -> str:
    """The longest anchor inside the word, or the word itself."""
    return max((a for a in ANCHORS if a in word), key=len, default=word)


LOGGISH = ("log", "print", "console", "echo")

# --------------------------------------------------------------------------
# Rule order, patterns, categories, severities, confidences and
# references decide the results and are stated as they must be.  Descriptions
# and advice are our own wording.
# --------------------------------------------------------------------------
SECURITY_RULES = [
    Rule("S01", "security", "Hardcoded Credentials", "CRITICAL", "HIGH", "i",
         r"""(api[_-]?key|apikey|api[_-]?secret|access[_-]?key)\s*[=:]\s*["\']([A-Za-z0-9+/]{20,})["\']""",
         "A07:2021 - Identification and Authentication Failures",
         "CIS Control 3.4 - Protect credentials",
         "API key literal in source",
         "Load the key at run time from a secret store or the environment and rotate the exposed one.",
         needs=(("api", "access"), ("key", "secret"))),
    Rule("S02", "security", "Hardcoded Credentials", "CRITICAL", "HIGH", "i",
         r"""(aws[_-]?access[_-]?key[_-]?id|aws[_-]?secret[_-]?access[_-]?key)\s*[=:]\s*["\']([A-Z0-9]{20,})["\']""",
         "A07:2021 - Identification and Authentication Failures",
         "CIS Control 3.4 - Protect credentials",
         "Cloud access key literal in source",
         "Attach an instance or workload role instead of embedding cloud keys.",
         needs=(("aws",), ("access",))),
    Rule("S03", "security", "Hardcoded Credentials", "CRITICAL", "MEDIUM", "i",
         r"""(password|passwd|pwd)\s*[=:]\s*["\'][^"\']{8,}["\']""",
         "A07:2021 - Identification and Authentication Failures",
         None,
         "Password literal in source",
         "Move the password to a secret store and read it when the process starts.",
         needs=(("passw", "pwd"),),
         suppress=(
             r"""password\s*[=:]\s*["\'][\*]+["\']""",
             r"""password\s*[=:]\s*["\']example["\']""",
             r"""password\s*[=:]\s*["\']<.*>["\']""",
         )),
    Rule("S04", "security", "Hardcoded Credentials", "CRITICAL", "HIGH", "",
         r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
         "A02:2021 - Cryptographic Failures",
         None,
         "Private key block in source",
         "Keep private keys in a key manager; treat this one as compromised.",
         needs=(("private key-----",),)),
    Rule("S05", "security", "Hardcoded Credentials", "HIGH", "HIGH", "i",
         r"""(jwt|bearer|token)\s*[=:]\s*["\']eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+["\']""",
         "A07:2021 - Identification and Authentication Failures",
         None,
         "Signed token literal in source",
         "Issue tokens per session and never store them with the code.",
         needs=(("eyj",),)),
    Rule("S06", "security", "SQL Injection", "CRITICAL", "HIGH", "is",
         r"""(execute|exec|cursor\.execute|db\.execute|query)\s*\([^)]*["\'].*\s*\+\s*[^"\']*["\'][^)]*\)""",
         "A03:2021 - Injection",
         "CIS Control 16.11 - Use secure programming",
         "Statement text built by concatenation",
         "Bind values as statement parameters rather than joining strings.",
         needs=(("+",), ("exec", "query"))),
    Rule("S07", "security", "SQL Injection", "CRITICAL", "HIGH", "is",
         r"""(execute|exec|cursor\.execute|db\.execute|query)\s*\([^)]*["\'].*\.(format|%)[^)]*\)""",
         "A03:2021 - Injection",
         None,
         "Statement text built by string formatting",
         "Replace the formatted string by a constant statement with bound parameters.",
         needs=(("exec", "query"), (".format", ".%"))),
    Rule("S08", "security", "SQL Injection", "CRITICAL", "HIGH", "i",
         r"""(execute|exec|cursor\.execute|db\.execute)\s*\(\s*f["\']""",
         "A03:2021 - Injection",
         None,
         "Statement text is an interpolated literal",
         "Use placeholders; interpolation puts raw input into the statement.",
         needs=(("exec",), ('f"', "f'"))),
    Rule("S09", "security", "Excessive Privileges", "HIGH", "HIGH", "i",
         r"""(use\s+role\s+accountadmin|role\s*[=:]\s*["\']accountadmin["\'])""",
         None,
         "CIS Control 5.4 - Restrict administrative privileges",
         "Account administrator role in use",
         "Run under a role that owns only what the job touches.",
         needs=(("accountadmin",),)),
    Rule("S10", "security", "Excessive Privileges", "MEDIUM", "MEDIUM", "i",
         r"select\s+\*\s+from",
         None,
         "CIS Control 3.3 - Configure data access control",
         "Every column is selected",
         "List the columns the caller needs.",
         needs=(("*",), ("select",), ("from",))),
    Rule("S11", "security", "SQL Injection", "CRITICAL", "MEDIUM", "is",
         r"(update|delete)\s+\w+\s+set\s+[^;]+;(?!\s*where)",
         "A03:2021 - Injection",
         None,
         "Data change without a visible row filter",
         "Restrict the statement with a filter and run it in a transaction.",
         needs=(("update", "delete"), ("set",), (";",))),
    Rule("S12", "security", "Command Injection", "CRITICAL", "HIGH", "is",
         r"(os\.system|subprocess\.call|subprocess\.run|exec|eval|shell\s*=\s*True)\s*\([^)]*\+[^)]*\)",
         "A03:2021 - Injection",
         "CIS Control 16.11 - Use secure programming",
         "Command text built by concatenation",
         "Pass an argument list and keep the shell out of it.",
         needs=(("+",), ("os.system", "subprocess", "exec", "eval", "shell"))),
    Rule("S13", "security", "Command Injection", "HIGH", "HIGH", "",
         r"\beval\s*\(",
         "A03:2021 - Injection",
         None,
         "Dynamic evaluation of text",
         "Parse data with a literal or JSON parser instead of evaluating it.",
         needs=(("eval",),)),
    Rule("S14", "security", "Insecure Cryptography", "HIGH", "HIGH", "i",
         r"(hashlib\.md5|md5\(|MD5)",
         "A02:2021 - Cryptographic Failures",
         "CIS Control 3.10 - Encrypt sensitive data",
         "MD5 digest in use",
         "Choose SHA-256 or newer, and a slow password hash for passwords.",
         needs=(("md5",),)),
    Rule("S15", "security", "Insecure Cryptography", "MEDIUM", "HIGH", "i",
         r"(hashlib\.sha1|sha1\(|SHA1)",
         "A02:2021 - Cryptographic Failures",
         None,
         "SHA-1 digest in use",
         "Choose SHA-256 or newer; collisions for SHA-1 are practical.",
         needs=(("sha1",),)),
    Rule("S16", "security", "Insecure Cryptography", "HIGH", "HIGH", "i",
         r"(DES|3DES|RC4|Blowfish)\.new\(",
         "A02:2021 - Cryptographic Failures",
         None,
         "Obsolete cipher in use",
         "Use an authenticated cipher such as AES-GCM.",
         needs=((".new(",),)),
    Rule("S17", "security", "Missing Authentication", "HIGH", "LOW", "",
         r"@app\.route\([^)]*\)\s*\n\s*def\s+\w+\s*\([^)]*\):",
         "A07:2021 - Identification and Authentication Failures",
         None,
         "Route handler with no guard between route and function",
         "Put an authentication guard on the handler unless it is meant to be public.",
         needs=(("@app.route(",),)),
    Rule("S18", "security", "Network Security", "HIGH", "HIGH", "i",
         r"(verify\s*=\s*False|ssl[_-]?verify\s*=\s*False|CERT_NONE)",
         "A02:2021 - Cryptographic Failures",
         "CIS Control 3.10 - Encrypt sensitive data",
         "Certificate checks are off",
         "Turn certificate checks on and install the missing authority instead.",
         needs=(("verify", "cert_none"),)),
    Rule("S19", "security", "Network Security", "MEDIUM", "MEDIUM", "i",
         r"""(host\s*=\s*["\']0\.0\.0\.0["\']|bind\s*=\s*["\']0\.0\.0\.0)""",
         None,
         "CIS Control 13.6 - Configure network access control",
         "Service listens on every interface",
         "Listen on a named interface and let a proxy or firewall expose it.",
         needs=(("0.0.0.0",),)),
    Rule("S20", "security", "Sensitive Data Exposure", "HIGH", "HIGH", "i",
         r"(debug\s*=\s*True|DEBUG\s*=\s*True|app\.debug\s*=\s*True)",
         "A05:2021 - Security Misconfiguration",
         None,
         "Debug mode is on",
         "Drive the debug switch from configuration and keep it off in production.",
         needs=(("debug",),)),
    Rule("S21", "security", "Insecure Deserialization", "HIGH", "MEDIUM", "",
         r"pickle\.loads?\(",
         "A08:2021 - Software and Data Integrity Failures",
         None,
         "Pickle input is loaded",
         "Exchange data in a format that cannot carry code, or verify a signature first.",
         needs=(("pickle.load",),)),
    Rule("S22", "security", "Unsafe File Operations", "HIGH", "MEDIUM", "is",
         r"(open|file)\s*\([^)]*\+[^)]*\)",
         "A01:2021 - Broken Access Control",
         None,
         "File path built by concatenation",
         "Resolve the path and check that it stays below the allowed directory.",
         needs=(("+",), ("open", "file"))),
    Rule("S23", "security", "Weak Random Number Generation", "MEDIUM", "HIGH", "",
         r"\brandom\.(random|randint|choice)\(",
         "A02:2021 - Cryptographic Failures",
         None,
         "Predictable random source",
         "Draw security-relevant values from a cryptographic generator.",
         needs=(("random.",),)),
]

PRIVACY_RULES = [
    Rule("V01", "privacy", "PII Exposure", "HIGH", "MEDIUM", "i",
         r"""(log|print|console|echo|write).*["\'].*\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b""",
         "GDPR Article 5(1)(f) - Integrity and confidentiality",
         "SOC 2 CC6.1",
         "E-mail address in an output statement",
         "Mask or hash addresses before they are written anywhere.",
         needs=(("@",), LOGGISH + ("write",)),
         gate=r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    Rule("V02", "privacy", "PII Exposure", "CRITICAL", "HIGH", "i",
         r"""(log|print|console|echo).*["\'].*\b\d{3}-\d{2}-\d{4}\b""",
         "GDPR Article 5(1)(f), HIPAA §164.514",
         "SOC 2 CC6.1",
         "Social security number in an output statement",
         "Write a token for the person, never the number.",
         needs=(LOGGISH, ("-",)),
         gate=r"\d{3}-\d{2}-\d{4}"),
    Rule("V03", "privacy", "PCI DSS Violation", "CRITICAL", "HIGH", "i",
         r"""(log|print|console|echo).*["\'].*\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b""",
         "PCI DSS 3.4",
         "PCI DSS Requirement 3",
         "Card number in an output statement",
         "Keep at most the last four digits in any output.",
         needs=(LOGGISH,),
         gate=r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}"),
    Rule("V04", "privacy", "PII Exposure", "HIGH", "MEDIUM", "i",
         r"""(log|print|console).*["\'].*\b\d{3}[-.]?\d{3}[-.]?\d{4}\b""",
         "GDPR Article 5(1)(f)",
         "SOC 2 CC6.1",
         "Telephone number in an output statement",
         "Mask or hash telephone numbers before output.",
         needs=(("log", "print", "console"),),
         gate=r"\d{3}[-.]?\d{3}[-.]?\d{4}"),
    Rule("V05", "privacy", "PII Exposure", "HIGH", "HIGH", "i",
         r"(log|logger|print|console)\.(info|debug|warn|error|log)\s*\([^)]*\b(user\.|customer\.|patient\.)?"
         r"(email|phone|ssn|social_security|address|dob|date_of_birth|credit_card|password)\b",
         "GDPR Article 5(1)(f)",
         "SOC 2 CC6.1",
         "Personal field handed to a logger",
         "Redact the field in the logging layer or drop it from the message.",
         needs=(("log", "print", "console"), (".info", ".debug", ".warn", ".error", ".log"))),
    Rule("V06", "privacy", "Missing Encryption", "CRITICAL", "HIGH", "i",
         r"(ssn|social_security|credit_card|card_number|cvv|tax_id)\s*(=|:)\s*models\.(CharField|TextField|String)",
         "PCI DSS 3.4, HIPAA §164.312(a)(2)(iv)",
         "GDPR Article 32",
         "Sensitive column declared as plain text",
         "Declare the column with an encrypting field type.",
         needs=(("models.",),)),
    Rule("V07", "privacy", "Missing Encryption", "HIGH", "HIGH", "i",
         r"""(url|endpoint|api_url)\s*=\s*["\']http://[^"\']*\b(user|customer|payment|health|medical|login|auth)\b""",
         "GDPR Article 32, HIPAA §164.312(e)(1)",
         "PCI DSS 4.1",
         "Sensitive endpoint reached without TLS",
         "Serve and call this endpoint over https only.",
         needs=(("http://",), ("url", "endpoint"))),
    Rule("V08", "privacy", "Missing Encryption", "HIGH", "MEDIUM", "i",
         r"(ftp://|FTP\()",
         "GDPR Article 32",
         "SOC 2 CC6.1",
         "Clear-text file transfer",
         "Transfer files over SSH or TLS.",
         needs=(("ftp",),)),
    Rule("V09", "privacy", "GDPR Violation", "HIGH", "LOW", "i",
         r"(collect|store|process).*\b(email|personal_data|user_data)\b",
         "GDPR Article 6, Article 7",
         "GDPR compliance",
         "Personal data is gathered with no consent in sight",
         "Check and record a lawful basis before gathering the data.",
         needs=(("email", "personal_data", "user_data"), ("collect", "store", "process"))),
    Rule("V10", "privacy", "Data Retention Issue", "MEDIUM", "LOW", "i",
         r"def\s+store_user_data|def\s+save_personal_info",
         "GDPR Article 5(1)(e) - Storage limitation",
         "GDPR compliance",
         "Personal data stored with no expiry in sight",
         "Give the stored data a retention period and delete on schedule.",
         needs=(("store_user_data", "save_personal_info"),)),
    Rule("V11", "privacy", "HIPAA Violation", "CRITICAL", "MEDIUM", "i",
         r"(log|print|console).*\b(patient|medical|diagnosis|prescription|health_record|phi|medical_record)\b",
         "HIPAA §164.514, §164.308(a)(1)(ii)(D)",
         "HIPAA Privacy Rule",
         "Health information in an output statement",
         "Output a de-identified reference in place of health data.",
         needs=(("log", "print", "console"),
                ("patient", "medical", "diagnosis", "prescription", "health_record", "phi"))),
    Rule("V12", "privacy", "HIPAA Violation", "CRITICAL", "HIGH", "i",
         r"(diagnosis|medical_record|prescription|health_data|phi)\s*=\s*models\.(CharField|TextField|String)(?!.*encrypt)",
         "HIPAA §164.312(a)(2)(iv)",
         "HIPAA Security Rule",
         "Health column declared as plain text",
         "Encrypt health columns at rest.",
         needs=(("models.",), ("diagnosis", "medical_record", "prescription", "health_data", "phi"))),
    Rule("V13", "privacy", "PCI DSS Violation", "CRITICAL", "HIGH", "i",
         r"(cvv|cvc|card_verification|security_code)\s*=\s*",
         "PCI DSS Requirement 3.2",
         "PCI DSS",
         "Card verification value is kept",
         "Never keep the verification value after authorisation.",
         needs=(("cvv", "cvc", "card_verification", "security_code"),)),
    Rule("V14", "privacy", "PCI DSS Violation", "CRITICAL", "HIGH", "i",
         r"(card_number|cardholder|pan|primary_account_number)\s*=\s*models\.(CharField|TextField|String)(?!.*encrypt)",
         "PCI DSS 3.4",
         "PCI DSS Requirement 3",
         "Cardholder column declared as plain text",
         "Encrypt cardholder columns with a strong cipher.",
         needs=(("models.",), ("card_number", "cardholder", "pan", "primary_account_number"))),
    Rule("V15", "privacy", "CCPA Violation", "HIGH", "LOW", "i",
         r"def\s+(sell|share).*\buser_data\b",
         "CCPA 1798.120",
         "CCPA compliance",
         "Personal data is sold or shared with no opt-out in sight",
         "Honour an opt-out choice before sharing personal data.",
         needs=(("user_data",), ("sell", "share"))),
    Rule("V16", "privacy", "SOC 2 Violation", "HIGH", "HIGH", "i",
         r"""(database_url|db_connection|connection_string)\s*=\s*["\'][^"\']*password=[^"\'@]+""",
         "SOC 2 CC6.1",
         "SOC 2",
         "Connection string carries its password",
         "Compose the connection string at run time from managed secrets.",
         needs=(("password=",), ("database_url", "db_connection", "connection_string"))),
    Rule("V17", "privacy", "Data Minimization Violation", "MEDIUM", "LOW", "i",
         r"(ssn|social_security|full_address|date_of_birth|driver_license)",
         "GDPR Article 5(1)(c)",
         "GDPR compliance",
         "High-risk identity field is gathered",
         "Confirm that the field is needed, and drop it otherwise.",
         needs=(("ssn", "social_security", "full_address", "date_of_birth", "driver_license"),)),
]

PERMISSION_RULES = [
    Rule("P01", "permission", "Missing Row-Level Security", "CRITICAL", "MEDIUM", "is",
         r"CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(\w+\.\w+\.\w+|\w+\.\w+|\w+)\s*\([^;]+\);(?!\s*CREATE\s+ROW\s+ACCESS\s+POLICY)",
         "OWASP API1:2023 - Broken Object Level Authorization (BOLA)",
         "CIS Snowflake Benchmark 2.1.1 - Implement Row-Level Security",
         "Table created without a row policy after it",
         "Attach a row access policy to the table in the same script.",
         needs=(("create",), ("table",), (");",))),
    Rule("P02", "permission", "Missing Row-Level Security", "CRITICAL", "HIGH", "is",
         r"CREATE\s+TABLE.*?\b(tenant_id|org_id|customer_id|account_id)\b",
         "OWASP API1:2023 - BOLA",
         "CIS Snowflake 2.1.1",
         "Table with a tenant column and no row policy",
         "Filter every read of tenant tables through a row access policy.",
         needs=(("create",), ("table",), ("tenant_id", "org_id", "customer_id", "account_id"))),
    Rule("P03", "permission", "Over-broad GRANT Permissions", "HIGH", "HIGH", "i",
         r"GRANT\s+ALL\s+(?:PRIVILEGES\s+)?ON\s+(?:SCHEMA|TABLE|DATABASE|WAREHOUSE)",
         "OWASP API5:2023 - Broken Function Level Authorization",
         "CIS Snowflake 1.4.2 - Use least privilege for GRANTs",
         "All privileges granted at once",
         "Name the privileges the role needs.",
         needs=(("grant",), ("all",))),
    Rule("P04", "permission", "PUBLIC Role Exposure", "HIGH", "HIGH", "i",
         r"GRANT\s+[A-Z, ]+\s+(?:ON|TO)\s+(?:ROLE\s+)?PUBLIC",
         "OWASP API5:2023 - BFLA",
         "CIS Snowflake 1.4.3 - Restrict PUBLIC role privileges",
         "Grant reaches every user",
         "Grant to a purpose-made role rather than to everyone.",
         needs=(("grant",), ("public",))),
    Rule("P05", "permission", "Over-broad GRANT Permissions", "MEDIUM", "LOW", "is",
         r"GRANT\s+SELECT\s+ON\s+TABLE\s+[^\s;]+(?!.*WHERE)",
         None,
         "CIS Snowflake 2.1.2",
         "Whole-table read grant",
         "Expose a filtered view or a row policy in place of the whole table.",
         needs=(("grant",), ("select",), ("table",))),
    Rule("P06", "permission", "ACCOUNTADMIN Misuse", "CRITICAL", "HIGH", "i",
         r"""(USE\s+ROLE\s+ACCOUNTADMIN|role\s*[=:]\s*["\']ACCOUNTADMIN["\']|ACCOUNTADMIN_ROLE|snowflake\.role\s*=\s*["\']ACCOUNTADMIN["\'])""",
         "OWASP API5:2023 - BFLA",
         "CIS Snowflake 1.1.1 - Restrict ACCOUNTADMIN usage",
         "Account administrator role in application code",
         "Give the application its own role; keep the top role for people.",
         needs=(("accountadmin",),)),
    Rule("P07", "permission", "ACCOUNTADMIN Misuse", "HIGH", "HIGH", "i",
         r"""(USE\s+ROLE\s+SECURITYADMIN|role\s*[=:]\s*["\']SECURITYADMIN["\'])""",
         None,
         "CIS Snowflake 1.1.2",
         "Security administrator role in application code",
         "Use the security role only for managing grants and users.",
         needs=(("securityadmin",),)),
    Rule("P08", "permission", "Insecure View", "HIGH", "LOW", "is",
         r"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+\w+.*?FROM\s+(\w+)(?!.*WHERE.*tenant_id)",
         "OWASP API1:2023 - BOLA",
         "CIS Snowflake 2.1.1",
         "View with no tenant filter in sight",
         "Filter the view by the caller's tenant.",
         needs=(("create",), ("view",), ("from",))),
    Rule("P09", "permission", "Insecure View", "MEDIUM", "LOW", "i",
         r"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(?!SECURE)",
         None,
         "CIS Snowflake 2.2.1 - Use SECURE views for sensitive data",
         "View definition is readable by its users",
         "Create the view as a secure view.",
         needs=(("create",), ("view",))),
    Rule("P10", "permission", "Missing Ownership Check (BOLA/IDOR)", "HIGH", "LOW", "is",
         r"SELECT\s+.*?FROM\s+(\w+).*?WHERE\s+(?!.*user_id)(?!.*owner_id)(?!.*tenant_id)(?!.*customer_id)(?!.*created_by)[^;]+",
         "OWASP API1:2023 - BOLA",
         None,
         "Row lookup with no owner condition",
         "Compare the owner or tenant column with the caller in the filter.",
         needs=(("where",), ("select",), ("from",))),
    Rule("P11", "permission", "Missing Ownership Check (BOLA/IDOR)", "CRITICAL", "HIGH", "i",
         r"(UPDATE|DELETE)\s+(?:FROM\s+)?(\w+\.\w+\.\w+|\w+\.\w+|\w+)(?!\s+WHERE)",
         "OWASP API1:2023 - BOLA",
         None,
         "Data change not followed by a row filter",
         "Filter by key and by owner in every update and delete.",
         needs=(("update", "delete"),)),
    Rule("P12", "permission", "Missing Authorization Check", "HIGH", "LOW", "i",
         r"""@(?:app|router)\.(get|post|put|delete|patch)\(["\'].*?/(?:users?|documents?|orders?|resources?)/\{?(\w+)\}?""",
         "OWASP API1:2023 - BOLA",
         None,
         "Object endpoint with no authorisation in sight",
         "Check the caller's right to the object before serving it.",
         needs=(("@app.", "@router."),)),
    Rule("P13", "permission", "Missing Ownership Check (BOLA/IDOR)", "HIGH", "LOW", "i",
         r"""(get_by_id|fetch_by_id|find_by_id|query\.get|session\.get|\.objects\.get)\s*\(\s*["\']?(\w+)["\']?\s*[,\)]""",
         "OWASP API1:2023 - BOLA",
         None,
         "Object fetched by identifier alone",
         "Compare the object's owner with the caller before returning it.",
         needs=(("get_by_id", "fetch_by_id", "find_by_id", "query.get", "session.get", ".objects.get"),)),
    Rule("P14", "permission", "Excessive Privileges", "MEDIUM", "MEDIUM", "is",
         r'resource\s+"snowflake_warehouse"[^}]+(?!resource_monitor)',
         None,
         "CIS Snowflake 1.5.1 - Configure resource monitors",
         "Warehouse resource declared",
         "Attach a resource monitor to the warehouse.",
         needs=(("snowflake_warehouse",),)),
    Rule("P15", "permission", "Excessive Privileges", "MEDIUM", "LOW", "is",
         r'resource\s+"snowflake_account"[^}]+(?!network_policy)',
         None,
         "CIS Snowflake 1.2.1 - Configure network policies",
         "Account resource declared",
         "Limit the account to known networks with a network policy.",
         needs=(("snowflake_account",),)),
]

BUILTIN_RULES = SECURITY_RULES + PRIVACY_RULES + PERMISSION_RULES
RULES_BY_AGENT = {
    "security": SECURITY_RULES,
    "privacy": PRIVACY_RULES,
    "permission": PERMISSION_RULES,
}
