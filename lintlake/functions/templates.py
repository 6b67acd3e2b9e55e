"""Reasoning templates: what a finding of a category means and how to mend it.

A template is a weakness of the public CWE list, described in our own words by
what it breaks, where it is met, how it is abused and what ends it, together with
the fixed values that decide results.  It is picked by reviewer, category and
variant; the variant comes from the evidence (see ``reasoning.py``).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Template:
    agent: str
    category: str
    variant: str
    check: str
    pattern: str
    method: str
    signals: tuple[str, ...]
    reason: str
    impact: str
    assets: tuple[str, ...]
    surface: str
    sensitivity: str
    compliance: tuple[str, ...]
    vector: str
    steps: tuple[str, ...]
    access: str
    rating: str
    cves: tuple[str, ...]
    factors: tuple[str, ...]
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    fix: str
    rationale: str
    alternatives: tuple[str, ...]
    complexity: str
    breaking: bool
    testing: str | None
    # How the record's confidence follows from the rule's (see CONFIDENCE_MODES).
    confidence: str = "rule"
    # When the weak evidence applies: always, unless_high, if_low.
    weak_when: str = "always"
    summary_chars: int = 100
    purpose: str | None = None
    flow: str | None = None
    present: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()
    file_purpose: str | None = None
    framework: str | None = None
    generic: bool = field(default=False)


# Each mode maps the rule's confidence to the record's.
CONFIDENCE_MODES = {
    "rule": {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW"},
    "high": {"HIGH": "HIGH", "MEDIUM": "HIGH", "LOW": "HIGH"},
    "medium": {"HIGH": "MEDIUM", "MEDIUM": "MEDIUM", "LOW": "MEDIUM"},
    "low": {"HIGH": "LOW", "MEDIUM": "LOW", "LOW": "LOW"},
    "medium_else_high": {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "HIGH"},
    "high_else_medium": {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "MEDIUM"},
    "low_else_medium": {"HIGH": "MEDIUM", "MEDIUM": "MEDIUM", "LOW": "LOW"},
    "medium_else_low": {"HIGH": "LOW", "MEDIUM": "MEDIUM", "LOW": "LOW"},
}


@dataclass(frozen=True)
class Weakness:
    """One entry of the list.  ``scopes`` are the security goals it breaks."""

    cwe: int
    title: str
    scopes: str
    reason: str
    harm: str
    entry: str
    abuse: str
    fix: str
    because: str
    test: str
    data: str


# Our own wording.
SQL = Weakness(
    89, "SQL command built from outside values", "confidentiality, integrity, access control",
    "The server cannot tell the author's SQL from SQL that arrives inside a value",
    "Queries return or alter rows the author never meant, and WHERE clauses that guard a login stop guarding",
    "a value that is concatenated or formatted into SQL", "a value closes the literal it sits in and continues as SQL",
    "Pass values as bind variables", "The statement is parsed before the value arrives, so the value stays a value",
    "Send a lone quote through each value; the result must equal that of any other unknown value", "every table the login may use")
SECRET = Weakness(
    798, "Secret literal in source", "authentication, confidentiality",
    "A literal is the same in every copy and cannot be withdrawn from the copies",
    "Whoever has had the source once can authenticate until somebody rotates the value",
    "any clone, package, container layer or backup of the source", "the literal is replayed from somewhere else",
    "Rotate the value and load it from a vault when the program starts",
    "What is not in the source does not travel with it", "Search the history with a secret scanner after the rotation", "what the secret unlocks")
COMMAND = Weakness(
    78, "Outside values reach an interpreter", "integrity, confidentiality, availability",
    "An interpreter gives meaning to metacharacters wherever they come from",
    "Instructions chosen by a stranger run with the rights of the service account",
    "a value that becomes part of the interpreted text", "metacharacters end the intended instruction and start another",
    "Call the program directly with a list of arguments, or use a library function",
    "Without an interpreter in between a metacharacter is an ordinary character",
    "Use arguments with semicolons, backticks and newlines and look for side effects", "files and networks the account reaches")
CIPHER = Weakness(
    327, "Algorithm below today's strength", "confidentiality, integrity",
    "Collisions or key recovery for it are within reach of rented hardware",
    "Integrity and secrecy claims that rest on it can be contested",
    "stored or transmitted values made with it", "two inputs with one digest, or a recovered key, replace the genuine value",
    "Re-create the values with an algorithm on a current approval list",
    "Approved lists drop an algorithm once its margin is gone", "Verify that old values are refused once migration ends", "values whose integrity or secrecy it keeps")
TLS = Weakness(
    295, "Peer certificate is not validated", "confidentiality, integrity",
    "An encrypted channel to an unknown peer protects against listeners but not against impostors",
    "A proxy nobody asked for may log and rewrite the session",
    "any hop or resolver that can redirect the connection", "the impostor presents a self-made certificate that is never examined",
    "Validate the chain and the host name, adding a private root where one is needed",
    "Validation ties the key to a name", "Point the client at an expired and at a foreign certificate; both must abort", "payload and session secrets")
BIND = Weakness(
    1327, "Socket bound to every address", "access control, availability",
    "The wildcard follows whatever networks the machine joins later",
    "An endpoint meant for neighbours answers callers from elsewhere",
    "each network the machine is attached to", "the endpoint is found by a sweep and used without its intended front door",
    "Bind to one configured address", "A named address keeps its meaning when networks change",
    "List listening sockets on the target and compare with the plan", "whatever the endpoint serves")
ROLE = Weakness(
    250, "Work done under an all-powerful role", "access control, accountability",
    "Rights that the task never uses are still there for whoever takes the session over",
    "One taken session changes users, keys and logs alike",
    "the connection that names the role", "a harmless-looking path is followed to the role's other rights",
    "Create a role from the list of operations the task performs", "Unused rights cannot be abused when they are absent",
    "Run the task under the new role and read the denials in the audit log", "the account as a whole")
WIDE = Weakness(
    359, "Query returns columns nobody asked for", "confidentiality",
    "Columns added to the table later appear in the result without review",
    "Fields cross a boundary that was drawn for other fields",
    "code that hands the row on", "a caller keeps fields it has no use for",
    "Name the columns", "A named list changes only when somebody edits it",
    "Add a marker column to the table; it must not show up downstream", "all columns of the table")
PICKLE = Weakness(
    502, "Objects rebuilt from a byte stream", "integrity, availability",
    "The format may name any callable to be invoked while it is read",
    "Reading a foreign stream equals running a foreign program",
    "streams that cross a trust boundary", "a stream names a callable of the attacker's liking",
    "Read records in JSON or a schema-bound binary format", "Those formats hold values but no callables",
    "Feed a stream with a harmless callable; it must be rejected unread", "the reading process")
PATH = Weakness(
    22, "File name taken from outside", "confidentiality, integrity",
    "Dot segments and absolute names are resolved after the folder was chosen",
    "The process opens files that belong to something else",
    "the name of the file to open", "dot segments climb above the folder",
    "Look names up in a table, or compare the real path with the folder's real path",
    "Only the resolved path shows which file is meant", "Ask for names with dot segments, links and absolute paths", "files the process may open")
DEBUG = Weakness(
    489, "Diagnostics left on", "confidentiality",
    "Diagnostics are written for the author and include state",
    "Stack frames, settings and fragments of requests are shown to callers",
    "responses to failing requests", "failures are provoked to read what they print",
    "Take the mode from deployment settings that default to off", "A default of off fails on the quiet side",
    "Deploy without settings and force an exception", "program state")
ROUTE = Weakness(
    306, "Entry point without a visible check", "access control",
    "Checks that are not next to the entry point are easily forgotten when it moves",
    "Unknown callers may reach the function behind it",
    "the address of the entry point", "it is called directly, past the pages that lead to it",
    "State next to it who may call, or that everybody may", "A stated rule can be reviewed and tested",
    "Call it with no identity and with a foreign one", "what the function returns or changes")
OUTPUT = Weakness(
    532, "Personal value written to a log", "confidentiality",
    "Logs are copied, indexed and kept under rules made for events, not for people",
    "The value outlives the purpose it was collected for",
    "every reader and every copy of the log", "log search is used as a directory of people",
    "Write a keyed hash or nothing", "A keyed hash links events without naming anybody",
    "Scan a day of logs with the pattern of this rule", "PII")
PLAIN = Weakness(
    311, "Sensitive value without encryption", "confidentiality",
    "Whoever holds the medium holds the value",
    "A lost disk, dump or capture discloses the value as it is",
    "disks, dumps and captures", "a copy is read with ordinary tools",
    "Encrypt before the value leaves the program, with keys kept elsewhere", "Without the key a copy is noise",
    "Dump the medium and search it for a planted value", "PII")
PLAIN_LINE = Weakness(
    319, "Sensitive value on an open line", "confidentiality, integrity",
    "Every hop of the line can read and alter what passes",
    "The value is disclosed on the way, unnoticed by both ends",
    "hops between the two ends", "traffic is mirrored and read",
    "Address the peer by https only", "The session key is known to the ends alone",
    "Capture a session and search it for a planted value", "PII")
CONSENT = Weakness(
    359, "Collection without a recorded basis", "privacy",
    "Lawfulness has to be shown, not assumed", "Processing may have to stop and collected rows be erased",
    "the code that collects", "somebody asks for the basis of a row and none is on file",
    "Store basis, purpose and time with the row", "A stored basis can be shown and withdrawn",
    "Pick rows at random and look for their basis", "PII")
SHARING = Weakness(
    359, "Transfer without a way to object", "privacy",
    "A right that cannot be exercised counts as denied", "Transfers may have to be undone with every recipient",
    "the code that transfers", "an objection arrives and the next transfer runs all the same",
    "Look up objections before each transfer", "The lookup makes an objection effective at once",
    "Record an objection and run the transfer", "PII")
HEALTH = Weakness(
    359, "Health information outside its safeguards", "confidentiality, privacy",
    "It cannot be changed once it is known", "Disclosure is reportable and harms people for good",
    "places where it is written", "records are joined with names from elsewhere",
    "Keep it in the safeguarded store and pass keys around instead", "A key says nothing to an outsider",
    "Search the outputs for terms of a test record", "PHI (Protected Health Information)")
CARD = Weakness(
    312, "Payment card element kept readable", "confidentiality",
    "Card rules ask for unreadable numbers and forbid keeping verification codes",
    "The merchant may lose the right to accept cards",
    "tables, files and memory dumps of the payment path", "elements are gathered until a payment succeeds elsewhere",
    "Hand the element to a token service and keep the token", "A token is worthless to anybody else",
    "Scan the stores for numbers that pass the check digit", "Financial + PII")
CONNECTION = Weakness(
    260, "Password inside a connection address", "authentication, confidentiality",
    "Addresses are logged, shown in errors and passed on as if they were public",
    "The database accepts whoever has seen the address",
    "logs, errors and settings that show the address", "the address is used as it stands",
    "Keep the address free of secrets and add them from a vault", "An address without a secret may be shown",
    "Print the effective address; it must hold no password", "Secrets and database")
KEEPING = Weakness(
    459, "Rows without an end of life", "privacy",
    "Data without a purpose is a liability without a use", "Each incident reaches further back than it should",
    "old partitions and backups", "years of rows are taken where months were needed",
    "Give every table a period and a job that enforces it", "An enforced period bounds what can be lost",
    "Insert a row dated before the period and run the job", "PII")
ROWS = Weakness(
    1220, "Rows of one table under one rule", "access control",
    "A grant on a table is a grant on every row of it", "One customer's session can list another's rows",
    "any query on the table", "the filter is left out of a query",
    "Attach a row access policy", "The engine applies a policy to queries that forget the filter",
    "Count rows under two customers' roles and compare with the table", "Multi-tenant data")
GRANT = Weakness(
    732, "Grant beyond the task", "access control",
    "Inherited and future objects come under a wide grant unseen", "The holder reaches objects created for others",
    "whoever may use the role", "the role is switched on and its list of objects is walked",
    "Grant single privileges on single objects", "Each privilege then has a reason on record",
    "Compare granted with used privileges over a month", "Depends on the objects")
VIEW = Weakness(
    497, "View that explains itself", "confidentiality, access control",
    "Its text and its optimiser behaviour tell about rows it filters out", "Names and values of base tables can be inferred",
    "the view's definition and its errors", "predicates with side effects are pushed below the filter",
    "Declare it secure and filter inside it", "A secure view is evaluated before outside predicates",
    "Ask for its definition under a reader role", "Depends on the tables")
OWNER = Weakness(
    639, "Object chosen by a key from the request", "access control",
    "Knowing a key is no permission", "Objects of other users are shown, changed or removed",
    "the key in the request", "keys are counted up or copied from elsewhere",
    "Select by key and by the caller's identity together", "A foreign key then selects nothing",
    "Replay a request with the key of another test user", "Depends on the objects")
PUBLIC = Weakness(
    276, "Privilege held by everybody", "access control",
    "The public role cannot be taken away from anybody", "Each new user and service receives the privilege at once",
    "any session of the account", "a forgotten service account is enough",
    "Move the privilege to a role with members", "Members can be listed and removed",
    "List what a user without roles can read", "Depends on the objects")
TENANT = Weakness(
    653, "Tenants kept apart by convention", "access control, confidentiality",
    "A convention holds until the first query that ignores it", "Answers mix rows of several customers",
    "shared tables, caches and queues", "a request is made without a tenant or with a foreign one",
    "Bind the tenant to the session and let the engine filter", "What the session carries cannot be left out",
    "Run every report under an empty tenant; it must stay empty", "Multi-tenant data")

DOUBT = ("The surrounding code may already prevent this",)


def _template(agent: str, category: str, variant: str, w: Weakness, compliance: tuple[str, ...], cves: tuple[str, ...] = (),
              *, about: str = "", rating: str = "Easy", complexity: str = "Easy", breaking: bool = False,
              doubt: bool = False, **more) -> Template:
    title = f"{w.title} ({about})" if about else w.title
    return Template(
        agent, category, variant, f"cwe_{w.cwe}", title, f"Rule for CWE-{w.cwe} on the source text", (f"CWE-{w.cwe}", *((about,) if about else ())),
        w.reason, w.harm, tuple(w.scopes.split(", ")), w.entry, more.pop("data", w.data), compliance,
        f"Through {w.entry}", (f"Reach {w.entry}", w.abuse[0].upper() + w.abuse[1:]), f"Control over {w.entry}", rating, cves,
        (f"The text has the form that CWE-{w.cwe} describes",), (title,), DOUBT if doubt else (), w.fix, w.because,
        (f"Mitigations listed for CWE-{w.cwe}",), complexity, breaking, w.test, **more)


def _generic(agent: str, data: str, compliance: tuple[str, ...] = ()) -> Template:
    """Pattern, signals, reason, factors and fix come from the rule's own text."""
    return Template(
        agent, "", "generic", "rule_text", "", "Rule on the source text", (), "", "Depends on where the code runs", ("code",),
        "the matched code", data, compliance, "Through the matched code", ("Reach the matched code",),
        "Depends on where the code runs", "Medium", (), (), ("Rule matched",), (), "", "The rule names the remedy", (), "Medium",
        False, None, generic=True)


# --------------------------------------------------------------------------
# Compliance tags, known-issue identifiers, exploitability
# ratings, complexities, breaking-change flags and confidence modes decide
# results.
# --------------------------------------------------------------------------
SECURITY = [
    _template("security", "SQL Injection", "", SQL,
              ("GDPR Article 32", "PCI DSS 6.5.1", "SOC 2 CC6.1", "HIPAA 164.312"),
              ("CVE-2019-16278", "CVE-2020-24949", "CVE-2021-41277")),
    *(_template("security", "Hardcoded Credentials", variant, SECRET,
                ("NIST SP 800-53 IA-5", "CIS Control 3.4", "PCI DSS 8.2.1", "GDPR Article 32"),
                ("CVE-2021-39175", "CVE-2022-24784", "CVE-2023-22620"), about=about, doubt=True, weak_when="unless_high")
      for variant, about in (("api", "interface key"), ("aws", "cloud key"), ("jwt", "bearer token"),
                             ("key", "private key"), ("password", "password"))),
    *(_template("security", "Command Injection", variant, COMMAND,
                ("CIS Control 16.11", "NIST SP 800-53 SI-10", "OWASP A03:2021"),
                ("CVE-2021-44228", "CVE-2022-22965", "CVE-2023-38545"), about=about, complexity="Medium")
      for variant, about in (("eval", "eval"), ("system", "os.system"), ("shell", "shell"), ("exec", "exec"),
                             ("process", "process"))),
    *(_template("security", "Insecure Cryptography", variant, CIPHER,
                ("NIST SP 800-131A", "PCI DSS 4.1", "FIPS 140-2", "GDPR Article 32"), ("CVE-2020-10735", "CVE-2017-15361"),
                about=about, rating="Medium" if variant == "sha1" else "Easy", breaking=True)
      for variant, about in (("md5", "MD5"), ("sha1", "SHA-1"), ("cipher", "old cipher"), ("other", "listed name"))),
    _template("security", "Network Security", "tls", TLS, ("PCI DSS 4.1", "NIST SP 800-52", "GDPR Article 32"),
              ("CVE-2014-0092", "CVE-2015-5237"), rating="Medium"),
    _template("security", "Network Security", "bind", BIND, ("CIS Control 13.6", "NIST SP 800-53 SC-7"),
              ("CVE-2021-3129", "CVE-2022-0847"), doubt=True),
    _template("security", "Excessive Privileges", "admin", ROLE, ("CIS Control 5.4", "SOC 2 CC6.1", "NIST SP 800-53 AC-6"),
              complexity="Medium", breaking=True),
    _template("security", "Excessive Privileges", "star", WIDE,
              ("GDPR Article 5 (data minimization)", "PCI DSS 3.2", "SOC 2 CC6.1"), rating="Medium", doubt=True),
    _template("security", "Insecure Deserialization", "", PICKLE, ("OWASP A08:2021", "CIS Control 16.11"),
              ("CVE-2019-16729", "CVE-2021-3177"), rating="Medium", complexity="Medium", breaking=True, doubt=True,
              confidence="medium_else_high"),
    _template("security", "Unsafe File Operations", "", PATH, ("OWASP A01:2021", "CIS Control 3.3"),
              ("CVE-2021-41773", "CVE-2022-24990"), complexity="Medium", doubt=True, confidence="medium_else_high"),
    _template("security", "Sensitive Data Exposure", "", DEBUG, ("OWASP A05:2021", "CIS Control 16.11"), ("CVE-2021-44228",)),
    _template("security", "Missing Authentication", "", ROUTE, ("OWASP A07:2021",), doubt=True, confidence="low"),
    _generic("security", "Unknown"),
]


def _plain(subject: str, http: bool) -> Template:
    tags = {"payment": ("PCI DSS 3.4", "PCI DSS Requirement 4.1", "GDPR Article 32"),
            "health": ("HIPAA §164.312(a)(2)(iv)", "HIPAA §164.312(e)(1)", "GDPR Article 32"),
            "other": ("GDPR Article 32", "SOC 2 CC6.1", "NIST SP 800-53 SC-13")}
    data = {"payment": "Financial + PII", "health": "PHI", "other": "PII"}
    return _template(
        "privacy", "Missing Encryption", subject + ("_http" if http else ""), PLAIN_LINE if http else PLAIN, tags[subject],
        ("CVE-2019-11043", "CVE-2021-3177"), about=subject, rating="Easy" if http else "Medium",
        complexity="Easy" if http else "Medium", breaking=not http, doubt=not http, data=data[subject])


PRIVACY = [
    *(_template("privacy", "PII Exposure", variant, OUTPUT,
                ("GDPR Article 5(1)(f)", "CCPA 1798.100(a)", "SOC 2 CC6.1", "HIPAA §164.514(b)"),
                ("CVE-2019-11043", "CVE-2021-22096"), about=about, summary_chars=80)
      for variant, about in (("email", "address"), ("ssn", "social security number"), ("phone", "phone number"), ("field", "named field"))),
    *(_plain(subject, http) for subject in ("payment", "health", "other") for http in (False, True)),
    _template("privacy", "GDPR Violation", "", CONSENT,
              ("GDPR Article 6 (Lawfulness)", "GDPR Article 7 (Consent)", "GDPR Article 5(1)(a) (Lawfulness, fairness, transparency)"),
              rating="N/A", complexity="Medium", breaking=True, doubt=True, confidence="low"),
    _template("privacy", "CCPA Violation", "", SHARING,
              ("CCPA 1798.120 (Right to Opt-Out)", "CCPA 1798.100 (Consumer Rights)", "CCPA 1798.115 (Disclosure Requirements)"),
              rating="N/A", complexity="Medium", breaking=True, doubt=True, confidence="low"),
    *(_template("privacy", "HIPAA Violation", variant, HEALTH,
                ("HIPAA §164.312(a)(2)(iv) (Encryption)", "HIPAA §164.308(a)(1)(ii)(D) (Information System Activity Review)",
                 "HIPAA §164.514(b) (De-identification)"),
                ("CVE-2015-0235", "CVE-2019-11043"), about=about, complexity="Medium", breaking=variant == "stored",
                confidence="medium_else_high")
      for variant, about in (("logs", "in output"), ("stored", "at rest"))),
    _template("privacy", "PCI DSS Violation", "cvv", CARD, ("PCI DSS Requirement 3.2", "PCI DSS Requirement 3.5", "GDPR Article 32"),
              ("CVE-2019-11043", "CVE-2021-3177"), about="verification code", breaking=True, confidence="high"),
    _template("privacy", "PCI DSS Violation", "number", CARD, ("PCI DSS 3.4", "PCI DSS Requirement 3.5", "GDPR Article 32"),
              ("CVE-2019-11043", "CVE-2021-3177"), about="card number", complexity="Hard", breaking=True, confidence="high"),
    _template("privacy", "SOC 2 Violation", "", CONNECTION,
              ("SOC 2 CC6.1 (Logical and Physical Access)", "SOC 2 CC6.2 (Authentication)", "NIST SP 800-53 IA-5"),
              ("CVE-2021-39175", "CVE-2022-24784"), confidence="high_else_medium"),
    _template("privacy", "Data Retention Issue", "", KEEPING,
              ("GDPR Article 5(1)(e) (Storage Limitation)", "GDPR Article 17 (Right to Erasure)", "CCPA 1798.105 (Right to Delete)"),
              rating="Medium", complexity="Medium", doubt=True, confidence="low"),
    _generic("privacy", "PII", ("{ref_primary}",)),
]

PERMISSION = [
    *(_template("permission", "Missing Row-Level Security", variant, ROWS,
                ("OWASP API1:2023 BOLA", "SOC 2 CC6.1", "CIS Snowflake Benchmark 2.1.1", "GDPR Article 32"),
                ("CVE-2020-15133", "CVE-2021-32740"), about=about, complexity="Medium", doubt=variant == "plain",
                confidence=level, summary_chars=80, purpose="table", flow="query to rows", missing=("row access policy",))
      for variant, about, level in (("tenant", "tenant column", "high"), ("plain", "", "medium"))),
    *(_template("permission", "Over-broad GRANT Permissions", variant, GRANT,
                ("CIS Snowflake 1.4.2", "SOC 2 CC6.3", "Principle of Least Privilege", "NIST SP 800-53 AC-6"), about=about,
                complexity="Medium", breaking=True, purpose="privileges", missing=("least privilege",))
      for variant, about in (("all", "every privilege"), ("some", ""))),
    _template("permission", "ACCOUNTADMIN Misuse", "", ROLE,
              ("CIS Snowflake 1.1.1", "SOC 2 CC6.1", "Separation of Duties", "NIST SP 800-53 AC-6"), about="application",
              complexity="Medium", breaking=True, confidence="high", purpose="session", missing=("least privilege",)),
    *(_template("permission", "Insecure View", ("secure" if secure else "open") + ("_filtered" if filtered else ""), VIEW,
                ("CIS Snowflake 2.2.1", "SOC 2 CC6.1"), rating="Medium", doubt=True, confidence="low_else_medium", purpose="view",
                missing=("" if secure else "secure view", "" if filtered else "tenant filter"))
      for secure in (True, False) for filtered in (True, False)),
    *(_template("permission", "Missing Ownership Check (BOLA/IDOR)", variant, OWNER,
                ("OWASP API1:2023 BOLA", "OWASP API5:2023 BFLA", "GDPR Article 32", "SOC 2 CC6.1"),
                ("CVE-2019-15107", "CVE-2020-5885", "CVE-2021-24145"), about=variant.split("_")[0] if variant != "other" else "",
                doubt=True, confidence="high" if variant in ("change", "change_select") else "medium_else_low",
                weak_when="if_low", purpose="object access", flow="key to object", missing=("owner comparison",))
      for variant in ("change", "change_select", "change_where", "change_where_select", "select", "api", "other")),
    _template("permission", "PUBLIC Role Exposure", "", PUBLIC,
              ("CIS Snowflake 1.4.3", "SOC 2 CC6.3", "Principle of Least Privilege"), complexity="Medium", breaking=True,
              confidence="high", purpose="privileges", missing=("role with members",)),
    _template("permission", "Tenant Isolation Issue", "", TENANT, ("SOC 2 CC6.1", "ISO 27001", "GDPR Article 32"),
              ("CVE-2020-15133", "CVE-2021-32740"), complexity="Medium", purpose="shared service", missing=("tenant binding",)),
    _generic("permission", "Unknown"),
]

TEMPLATES: list[Template] = [*SECURITY, *PRIVACY, *PERMISSION]

TEMPLATE_INDEX = {(t.agent, t.category, t.variant): i for i, t in enumerate(TEMPLATES)}
