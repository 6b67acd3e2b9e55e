"""Facts about Python files, and the syntax checks as filters on them.

Parsing needs Python; one Arrow-batched pass turns each file into rows about
its assignments and calls.  Everything that decides what a finding is stays in
column expressions over those rows.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lintlake.functions import text
from lintlake.functions.constants import contains_any, rows_literal, texts_literal
from lintlake.functions.severity import AGENTS, SEVERITIES

# Workers get the parsing functions by value, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACT_SCHEMA = T.StructType([
    T.StructField("fact_ordinal", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("func_name", T.StringType()),
    T.StructField("value_str", T.StringType()),
    T.StructField("arg0_kind", T.StringType()),
    T.StructField("shell_true", T.BooleanType()),
    T.StructField("args", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("encrypted", T.BooleanType()),
])
# Facts that leave the parser at once.
FACTS_AT_ONCE = 5_000
# Words that tell of protection.
ENCRYPTION_WORDS = ["encrypt", "cipher", "aes", "crypto", "secure"]


def _dotted(func: ast.expr) -> str:
    """``a.b.c`` for a chain of attributes; only its tail if it starts elsewhere."""
    tail: list[str] = []
    while isinstance(func, ast.Attribute):
        tail.insert(0, func.attr)
        func = func.value
    if isinstance(func, ast.Name):
        tail.insert(0, func.id)
    return ".".join(tail)


def _names_under(node: ast.AST) -> list[str]:
    found = set()
    for child in ast.walk(node):
        label = getattr(child, "attr", None) if isinstance(child, ast.Attribute) else getattr(child, "id", None)
        if label is not None:
            found.add(label.lower())
    return sorted(found)


def _first_argument(call: ast.Call) -> str | None:
    if not call.args:
        return None
    first = call.args[0]
    if isinstance(first, ast.JoinedStr):
        return "fstring"
    if isinstance(first, ast.BinOp) and isinstance(first.op, ast.Add):
        return "add"
    return "other"


def file_facts(content: str) -> Iterator[dict]:
    """Facts of one file, breadth first; none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            nodes = list(ast.walk(ast.parse(content)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = content.split("\n")
    told: dict[tuple[int, int], bool] = {}

    def encrypted(first: int, last: int) -> bool:
        """Whether the lines of a statement mention protection; each run of lines is read once."""
        if (first, last) not in told:
            statement = "\n".join(lines[first - 1:last]).lower()
            told[first, last] = any(word in statement for word in ENCRYPTION_WORDS)
        return told[first, last]

    count = 0
    for node in nodes:
        if isinstance(node, ast.Assign):
            literal = getattr(node.value, "value", None) if isinstance(node.value, ast.Constant) else None
            rows = [
                {
                    "kind": "assign",
                    "name": target.id,
                    "value_str": literal if isinstance(literal, str) else None,
                    "encrypted": encrypted(node.lineno, node.end_lineno),
                }
                for target in node.targets
                if isinstance(target, ast.Name)
            ]
        elif isinstance(node, ast.Call):
            switches = [k.value for k in node.keywords if k.arg == "shell"]
            rows = [{
                "kind": "call",
                "func_name": _dotted(node.func),
                "arg0_kind": _first_argument(node),
                "shell_true": any(isinstance(v, ast.Constant) and v.value is True for v in switches),
                "args": [_names_under(a) for a in node.args],
            }]
        else:
            continue
        for row in rows:
            row.update(fact_ordinal=count, line=node.lineno, end_line=node.end_lineno)
            count += 1
            yield row


def _printable(value):
    """Arrow carries UTF-8 only; a lone surrogate in a literal becomes '?'."""
    return value.encode("utf-8", "replace").decode("utf-8") if isinstance(value, str) else value


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each file, and its facts in rows of some thousand."""
    kind = to_arrow_schema(T.StructType([T.StructField("facts", T.ArrayType(FACT_SCHEMA))])).field(0).type
    for batch in batches:
        for i, content in enumerate(batch.column("content")):
            facts = iter(file_facts(content.as_py() or ""))
            while part := list(islice(facts, FACTS_AT_ONCE)):
                for fact in part:
                    fact["value_str"] = _printable(fact.get("value_str"))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, 1) for c in batch.columns), pa.array([part], kind)], names=[*batch.schema.names, "facts"])


def is_python(path: Column) -> Column:
    return F.endswith(path, F.lit(".py"))


def py_facts(corpus: DataFrame, *, with_content: bool = False) -> DataFrame:
    """Assignments and calls of every Python file of the corpus.

    A fact tells where it stands, not what stands around it, so the output is
    linear in the input however long the lines are.  ``with_content`` adds the
    file's text, once for some thousand facts.
    """
    files = corpus.where(is_python(F.col("path"))).select("repo", "path", "content")
    schema = T.StructType([*files.schema.fields, T.StructField("facts", T.ArrayType(FACT_SCHEMA))])
    keep = ["repo", "path", "content"] if with_content else ["repo", "path"]
    return files.mapInArrow(_batches, schema).select(*keep, F.inline("facts"))


def facts_of(path: Column, content: Column) -> Column:
    """The facts of a file as one array, null where the file is not Python.

    Only the text of Python files travels to the parser; everything else stays
    where it is.
    """
    kind = to_arrow_schema(T.StructType([T.StructField("facts", T.ArrayType(FACT_SCHEMA))])).field(0).type

    @F.arrow_udf(T.ArrayType(FACT_SCHEMA))
    def parsed(texts: pa.Array) -> pa.Array:
        def facts(content):
            found = list(file_facts(content))
            for fact in found:
                fact["value_str"] = _printable(fact.get("value_str"))
            return found

        return pa.array([None if text is None else facts(text) for text in texts.to_pylist()], kind)

    return parsed(F.when(is_python(path), content))


# --------------------------------------------------------------------------
# Names and words the checks look for, and the texts that later
# steps read flags from.
# --------------------------------------------------------------------------
SECRET_NAMES = [
    "password", "passwd", "pwd", "api_key", "apikey", "secret",
    "token", "auth_token", "access_token", "private_key",
]
PLACEHOLDERS = [
    "example", "test", "dummy", "placeholder", "changeme",
    "xxx", "***", "<", ">", "todo", "fixme",
]
EXECUTE_WORDS = ["execute", "query", "exec"]
SHELL_CALLS = ["os.system", "subprocess.call", "subprocess.run", "exec", "eval"]
ALWAYS_RISKY = ["os.system", "exec", "eval"]
INSECURE_FUNCTIONS = {
    "pickle.loads": "Insecure Deserialization",
    "pickle.load": "Insecure Deserialization",
    "random.random": "Weak Random Number Generation",
    "random.randint": "Weak Random Number Generation",
}
PII_NAMES = [
    "email", "phone", "phone_number", "ssn", "social_security",
    "address", "street_address", "credit_card", "card_number",
    "password", "date_of_birth", "dob", "drivers_license",
    "passport", "medical_record", "diagnosis", "patient_name",
]
GRAVE_PII_NAMES = ["ssn", "social_security", "credit_card", "medical_record"]
LOGGING_WORDS = ["log", "print", "console", "logger"]
SENSITIVE_NAMES = [
    "ssn", "social_security", "credit_card", "card_number", "cvv", "cvc",
    "password", "medical_record", "diagnosis", "health_data", "phi",
]

INJECTION_REF = "A03:2021 - Injection"
CREDENTIAL_REF = "A07:2021 - Identification and Authentication Failures"
INTEGRITY_REF = "A08:2021 - Software and Data Integrity Failures"

# Our own wording.
ADVICE = {
    "E1": "Read the secret from a store or the environment.",
    "E2": "Bind values as parameters of a constant statement.",
    "E3": "Start processes from an argument list and never evaluate text.",
    "Insecure Deserialization": "Exchange data in a plain format.",
    "Weak Random Number Generation": "Draw from a cryptographic generator.",
    "E5": "Mask personal fields before they are logged.",
    "E6": "Protect the field with encryption.",
}

# Syntax findings come after a reviewer's regex findings.
AST_ORDINAL_BASE = 1000


def is_placeholder(value: Column) -> Column:
    return contains_any(F.lower(value), PLACEHOLDERS)


def is_execute_call(func_name: Column) -> Column:
    return contains_any(func_name, EXECUTE_WORDS)


def is_logging_call(func_name: Column) -> Column:
    return contains_any(F.lower(func_name), LOGGING_WORDS)


def _label(check: int, agent: str, *, category: str, severity: str, confidence: str, advice: str, ref_primary: str,
           ref_secondary: str | None, description: str, context: bool = True) -> dict[str, object]:
    return {
        "rule_id": f"E{check}",
        "agent": agent,
        "agent_rank": AGENTS.index(agent),
        "rule_ordinal": AST_ORDINAL_BASE + check,
        "category": category,
        "severity": severity,
        "sev_rank": SEVERITIES.index(severity),
        "confidence": confidence,
        "recommendation": advice,
        "ref_primary": ref_primary,
        "ref_secondary": ref_secondary,
        "description": description,
        "with_context": context,
    }


# How a statement may be built from text, by the kind of its first argument.
BUILT_BY = {"fstring": "f-string interpolation", "add": "string concatenation"}


def syntax_labels() -> list[dict[str, object]]:
    """Everything a syntax finding may be labelled with; a finding names its label by position."""
    return [
        _label(1, "security", category="Hardcoded Credentials", severity="CRITICAL", confidence="MEDIUM",
               advice=ADVICE["E1"], ref_primary=CREDENTIAL_REF, ref_secondary=None, description="Secret assigned to a variable"),
        *(_label(2, "security", category="SQL Injection", severity="CRITICAL", confidence="HIGH", advice=ADVICE["E2"],
                 ref_primary=INJECTION_REF, ref_secondary=None, description=f"Statement built by {way}")
          for way in BUILT_BY.values()),
        *(_label(3, "security", category="Command Injection", severity="CRITICAL" if name == "eval" else "HIGH",
                 confidence="HIGH", advice=ADVICE["E3"], ref_primary=INJECTION_REF, ref_secondary=None,
                 description=f"Command run by {name}")
          for name in SHELL_CALLS),
        *(_label(4, "security", category=group, severity="MEDIUM", confidence="HIGH", advice=ADVICE[group],
                 ref_primary=INTEGRITY_REF, ref_secondary=None, description=f"Use of {name}", context=False)
          for name, group in INSECURE_FUNCTIONS.items()),
        *(_label(5, "privacy", category="PII Exposure", severity=severity, confidence="HIGH", advice=ADVICE["E5"],
                 ref_primary="GDPR Article 5(1)(f)", ref_secondary="SOC 2 CC6.1", description="Personal field in a logging call")
          for severity in ("CRITICAL", "HIGH")),
        _label(6, "privacy", category="Missing Encryption", severity="CRITICAL", confidence="HIGH", advice=ADVICE["E6"],
               ref_primary="GDPR Article 32, PCI DSS 3.4", ref_secondary="PCI DSS, HIPAA",
               description="Sensitive variable without protection"),
    ]


def syntax_hits(f: Callable[[str], Column], agents: list[str]) -> Column:
    """What the checks of the reviewers find in one fact, ``f`` giving its fields: ``array<label, evidence>``."""
    first = {}
    for i, label in enumerate(syntax_labels()):
        first.setdefault(label["rule_id"], i)

    def hit(condition: Column, label: Column, evidence: Column) -> Column:
        return F.when(condition, F.struct(label.cast("int").alias("label"), text.clip(evidence, text.FINDING_EVIDENCE_CAP).alias("evidence")))

    def nth(check: str, values: Iterable[str], value: Column) -> Column:
        return F.array_position(texts_literal(list(values)), value) - 1 + first[check]

    name, func = F.lower(f("name")), f("func_name")
    assign, call = f("kind") == "assign", f("kind") == "call"
    ways = F.create_map(*[F.lit(x) for pair in BUILT_BY.items() for x in pair])
    personal = F.filter(f("args"), lambda a: F.arrays_overlap(a, texts_literal(PII_NAMES)))
    grave = F.arrays_overlap(F.get(personal, F.lit(0)), texts_literal(GRAVE_PII_NAMES))
    checks = {
        "security": [
            hit(assign & contains_any(name, SECRET_NAMES) & (f("value_str") != "") & ~is_placeholder(f("value_str")),
                F.lit(first["E1"]), F.concat(f("name"), F.lit(" = '"), F.substring(f("value_str"), 1, 50), F.lit("...'"))),
            hit(call & is_execute_call(func) & f("arg0_kind").isin(list(BUILT_BY)), nth("E2", BUILT_BY, f("arg0_kind")),
                F.concat(F.lit("SQL query uses "), F.try_element_at(ways, f("arg0_kind")))),
            hit(call & func.isin(SHELL_CALLS) & (f("shell_true") | func.isin(ALWAYS_RISKY)), nth("E3", SHELL_CALLS, func),
                F.concat(F.lit("Dangerous function call: "), func, F.when(f("shell_true"), " with shell=True").otherwise(""))),
            hit(call & func.isin(list(INSECURE_FUNCTIONS)), nth("E4", INSECURE_FUNCTIONS, func),
                F.concat(F.lit("Insecure function: "), func)),
        ],
        "privacy": [
            hit(call & is_logging_call(func) & (F.size(personal) > 0), F.when(grave, first["E5"]).otherwise(first["E5"] + 1),
                F.concat(F.lit("Logging PII field in statement at line "), f("line").cast("string"))),
            hit(assign & contains_any(name, SENSITIVE_NAMES) & ~f("encrypted"), F.lit(first["E6"]),
                F.concat(F.lit("Sensitive field '"), f("name"), F.lit("' without encryption"))),
        ],
        "permission": [],
    }
    return F.array_compact(F.array(*[c for agent in agents for c in checks[agent]]))


def ast_findings(
    facts: DataFrame, agents: list[str] | None = None, *, with_context: bool = False
) -> DataFrame:
    """Findings of the syntax checks, in the layout of the regex findings.

    Contexts need facts with their file's content; they are cut from it for the
    findings only.
    """
    from lintlake.operators.scan import FINDING_COLUMNS

    kept = ["content"] if with_context else []
    found = facts.select(
        "repo", "path", "fact_ordinal", "line", *kept, F.explode(syntax_hits(F.col, agents or AGENTS)).alias("_h"))
    labelled = found.withColumn("_f", F.get(rows_literal(syntax_labels()), F.col("_h.label")))
    own = {
        "repo": F.col("repo"),
        "path": F.col("path"),
        "detector": F.lit("ast"),
        "match_ordinal": F.col("fact_ordinal"),
        "line_number": F.col("line"),
        "evidence": F.col("_h.evidence"),
    }
    columns = [own.get(name, F.col(f"_f.{name}")).alias(name) for name in FINDING_COLUMNS]
    if with_context:
        lines = F.split("content", "\n")
        columns.append(F.when(F.col("_f.with_context"), text.context_window(lines, F.col("line"))).alias("context"))
    return labelled.select(*columns)
