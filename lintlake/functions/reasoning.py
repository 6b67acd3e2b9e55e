"""Reasoning records as column expressions.

A finding's record is a function of its template, its rule and its evidence,
so only a small index has to travel with a finding; the text is filled in at
the very end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.functions.constants import bound, contains_any, index_literal, rows_literal
from lintlake.functions.templates import CONFIDENCE_MODES, TEMPLATE_INDEX, TEMPLATES, Template

# Word lists that pick a template's variant or a signal.
TENANT_WORDS = ["tenant_id", "org_id", "customer_id", "account_id"]
PAYMENT_WORDS = ["card", "cvv", "credit", "payment"]
HEALTH_WORDS = ["medical", "health", "phi", "diagnosis"]
VERIFICATION_WORDS = ["cvv", "cvc", "security_code"]
OUTPUT_WORDS = ["log", "print", "console"]
OLD_CIPHERS = ["DES", "3DES", "RC4", "Blowfish"]
ENDPOINT_METHODS = ["get", "post", "put", "delete"]
BOUND_VALUE_MARKS = ["?", "%s", "paramstyle"]
SSN_SHAPE = r"\d{3}-\d{2}-\d{4}"
PHONE_SHAPE = r"\d{3}[-.]?\d{3}[-.]?\d{4}"
MAX_AGENTS = 3

STRINGS = T.ArrayType(T.StringType())


def typed(kind: T.StructType, *parts: Column) -> Column:
    """A struct of exactly this type."""
    leaf = (T.StructType, T.ArrayType)
    return F.struct(*[
        (part if isinstance(f.dataType, leaf) else part.cast(f.dataType)).alias(f.name)
        for f, part in zip(kind, parts, strict=True)
    ]).cast(kind)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _B, _I = T.StringType(), T.BooleanType(), T.IntegerType()
RECORD_TYPE = _struct(
    detection=_struct(pattern_matched=_S, evidence_summary=_S, detection_method=_S,
                      signals_observed=STRINGS, agent_name=_S, check_name=_S),
    risk=_struct(severity_reasoning=_S, impact_description=_S, affected_assets=STRINGS,
                 attack_surface=_S, data_sensitivity=_S, compliance_impact=STRINGS),
    attack=_struct(attack_vector=_S, attack_steps=STRINGS, required_access=_S,
                   exploitability_rating=_S, similar_cves=STRINGS, exploit_examples=_S),
    confidence=_struct(confidence_level=_S, primary_factors=STRINGS, strong_evidence=STRINGS,
                       weak_evidence=STRINGS, agent_agreement=_I, agreement_details=_S),
    remediation=_struct(recommended_fix=_S, fix_rationale=_S, alternative_fixes=STRINGS, tradeoffs=_S,
                        implementation_complexity=_S, breaking_changes=_B, testing_guidance=_S),
    context=_struct(function_purpose=_S, data_flow=_S, surrounding_controls=STRINGS,
                    missing_controls=STRINGS, file_purpose=_S, framework_context=_S),
    false_positive=_struct(is_likely_false_positive=_B, reasoning=_S, ambiguity_factors=STRINGS,
                           validation_needed=_S, confidence_boosters=STRINGS, confidence_detractors=STRINGS),
    alternatives=_struct(possible_legitimate_uses=STRINGS, counterarguments=STRINGS,
                         requires_human_judgment=_B),
    generated_by_agent=_S,
    generated_at=_S,
)


def _has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def _choose(*cases: tuple[Column | None, str]) -> Column:
    """First case whose condition holds; the last one carries no condition."""
    result = F.lit(cases[-1][1])
    for condition, value in reversed(cases[:-1]):
        result = F.when(condition, F.lit(value)).otherwise(result)
    return result


def _variants(evidence: Column) -> dict[tuple[str, str], Column]:
    """The variant of every category that has more than one."""
    low, up = F.lower(evidence), F.upper(evidence)
    change = contains_any(up, ["UPDATE", "DELETE"])
    where, select = _has(up, "WHERE"), _has(up, "SELECT")
    endpoint = _has(evidence, "@") & contains_any(evidence, ENDPOINT_METHODS)
    subject = _choose((contains_any(low, PAYMENT_WORDS), "payment"), (contains_any(low, HEALTH_WORDS), "health"), (None, "other"))
    filtered = _has(low, "tenant_id") | where
    return {
        ("security", "Hardcoded Credentials"): _choose(
            (_has(low, "api"), "api"), (_has(low, "aws"), "aws"), (contains_any(low, ["jwt", "bearer"]), "jwt"),
            (_has(evidence, "PRIVATE KEY"), "key"), (None, "password")),
        ("security", "Command Injection"): _choose(
            (_has(evidence, "eval"), "eval"), (_has(evidence, "os.system"), "system"), (_has(low, "shell"), "shell"),
            (_has(evidence, "exec"), "exec"), (None, "process")),
        ("security", "Insecure Cryptography"): _choose(
            (_has(low, "md5"), "md5"), (_has(low, "sha1"), "sha1"), (contains_any(evidence, OLD_CIPHERS), "cipher"),
            (None, "other")),
        ("security", "Network Security"): _choose((contains_any(low, ["verify", "cert_none"]), "tls"), (None, "bind")),
        ("security", "Excessive Privileges"): _choose((_has(low, "accountadmin"), "admin"), (None, "star")),
        ("privacy", "PII Exposure"): _choose(
            (_has(evidence, "@") | _has(low, "email"), "email"), (F.rlike(evidence, F.lit(SSN_SHAPE)), "ssn"),
            (F.rlike(evidence, F.lit(PHONE_SHAPE)), "phone"), (None, "field")),
        ("privacy", "Missing Encryption"): F.concat(
            subject, F.when(_has(low, "http://"), F.lit("_http")).otherwise(F.lit(""))),
        ("privacy", "HIPAA Violation"): _choose((contains_any(low, OUTPUT_WORDS), "logs"), (None, "stored")),
        ("privacy", "PCI DSS Violation"): _choose((contains_any(low, VERIFICATION_WORDS), "cvv"), (None, "number")),
        ("permission", "Missing Row-Level Security"): _choose((contains_any(low, TENANT_WORDS), "tenant"), (None, "plain")),
        ("permission", "Over-broad GRANT Permissions"): _choose((_has(up, "GRANT ALL"), "all"), (None, "some")),
        ("permission", "Insecure View"): F.concat(
            F.when(_has(up, "SECURE"), F.lit("secure")).otherwise(F.lit("open")),
            F.when(filtered, F.lit("_filtered")).otherwise(F.lit(""))),
        ("permission", "Missing Ownership Check (BOLA/IDOR)"): F.when(
            change,
            F.concat(F.lit("change"), F.when(where, F.lit("_where")).otherwise(F.lit("")),
                     F.when(select, F.lit("_select")).otherwise(F.lit(""))),
        ).otherwise(_choose((select, "select"), (endpoint, "api"), (None, "other"))),
    }


def template_index(agent: Column, category: Column, evidence: Column) -> Column:
    """Position of the finding's template; unlisted categories get the generic one."""
    variant = F.lit("")
    for (owner, name), choice in _variants(evidence).items():
        variant = F.when((agent == owner) & (category == name), choice).otherwise(variant)
    positions = index_literal({"/".join(key): i for key, i in TEMPLATE_INDEX.items()})
    return F.coalesce(
        F.try_element_at(positions, F.concat_ws("/", agent, category, variant)),
        F.try_element_at(positions, F.concat(agent, F.lit("//generic"))),
    )


def _template_row(t: Template) -> dict[str, object]:
    levels = CONFIDENCE_MODES[t.confidence]
    return {
        "agent": t.agent, "check": t.check, "pattern": t.pattern, "method": t.method, "signals": t.signals,
        "reason": t.reason, "impact": t.impact, "assets": t.assets, "surface": t.surface,
        "sensitivity": t.sensitivity, "compliance": t.compliance, "vector": t.vector, "steps": t.steps,
        "access": t.access, "rating": t.rating, "cves": t.cves, "factors": t.factors, "strong": t.strong,
        "weak": t.weak, "fix": t.fix, "rationale": t.rationale, "fixes": t.alternatives,
        "complexity": t.complexity, "breaking": t.breaking, "testing": t.testing, "if_high": levels["HIGH"],
        "if_medium": levels["MEDIUM"], "if_low": levels["LOW"], "weak_when": t.weak_when,
        "summary_chars": t.summary_chars, "purpose": t.purpose, "flow": t.flow, "present": t.present,
        "missing": t.missing, "file_purpose": t.file_purpose, "framework": t.framework, "generic": t.generic,
    }


def templates_literal() -> Column:
    return rows_literal([_template_row(t) for t in TEMPLATES])


def evidence_signals(item: Column) -> Column:
    """Signals that depend on the evidence, beyond the template's fixed ones."""
    evidence = item["evidence"]
    low, up = F.lower(evidence), F.upper(evidence)

    def shown(condition: Column, label: str) -> Column:
        return F.when(condition, F.lit(label))

    statement = F.array(
        shown(_has(evidence, "+") | _has(low, "concat"), "value added by an operator"),
        shown(_has(evidence, "format") | _has(evidence, "%"), "value added by formatting"),
        shown(_has(evidence, "f'") | _has(evidence, 'f"'), "value inside an f-string"),
        shown(_has(low, "execute"), "run on the same line"),
        shown(~contains_any(evidence, BOUND_VALUE_MARKS), "no bind marker"),
    )
    command = F.array(shown(_has(low, "shell") & _has(low, "true"), "shell=True"))
    grant = F.array(
        F.lit("grant"), shown(_has(up, "GRANT ALL"), "every privilege"), shown(_has(up, "PUBLIC"), "everybody"))
    return F.array_compact(
        F.when(item["category"] == "SQL Injection", statement)
        .when(item["category"] == "Command Injection", command)
        .when(item["category"] == "Over-broad GRANT Permissions", grant)
        .otherwise(F.array().cast(STRINGS))
    )


def signals(item: Column, t: Column) -> Column:
    own = F.when(t["generic"], F.array(item["description"])).otherwise(evidence_signals(item))
    return F.concat(t["signals"], own)


def record(item: Column) -> Column:
    """The full reasoning record of one finding.

    ``item`` is a struct with the finding's agent, category, severity,
    confidence, line_number, evidence, description, recommendation,
    ref_primary, template_ix and generated_at.
    """
    return bound(F.get(templates_literal(), item["template_ix"]), lambda t: _record(item, t))


def _record(item: Column, t: Column) -> Column:
    no_text = F.lit(None).cast("string")
    generic = t["generic"]
    level = (
        F.when(item["confidence"] == "HIGH", t["if_high"])
        .when(item["confidence"] == "MEDIUM", t["if_medium"])
        .otherwise(t["if_low"])
    )
    weak = F.when(
        (t["weak_when"] == "always")
        | ((t["weak_when"] == "unless_high") & (level != "HIGH"))
        | ((t["weak_when"] == "if_low") & (level == "LOW")),
        t["weak"],
    ).otherwise(F.array().cast(STRINGS))
    summary = F.concat(
        F.lit("Line "), item["line_number"].cast("string"), F.lit(": "),
        F.when(t["summary_chars"] == 80, F.substring(item["evidence"], 1, 80))
        .otherwise(F.substring(item["evidence"], 1, 100)))
    compliance = (
        F.when(generic & (item["agent"] == "privacy"), F.array_compact(F.array(item["ref_primary"])))
        .when(~generic, t["compliance"])
    )

    def own_or(template_value: Column, rule_value: Column) -> Column:
        return F.when(generic, rule_value).otherwise(template_value)

    return typed(
        RECORD_TYPE,
        typed(
            RECORD_TYPE["detection"].dataType,
            own_or(t["pattern"], item["description"]), summary, t["method"], signals(item, t), t["agent"], t["check"]),
        typed(
            RECORD_TYPE["risk"].dataType,
            own_or(t["reason"], F.concat(item["severity"], F.lit(" severity: "), item["description"])),
            t["impact"], t["assets"], t["surface"], t["sensitivity"], compliance),
        typed(
            RECORD_TYPE["attack"].dataType,
            t["vector"], t["steps"], t["access"], t["rating"], F.when(~generic, t["cves"]), no_text),
        typed(
            RECORD_TYPE["confidence"].dataType,
            level, own_or(t["factors"], F.array(item["description"])), t["strong"], weak, F.lit(1), no_text),
        typed(
            RECORD_TYPE["remediation"].dataType,
            own_or(t["fix"], item["recommendation"]), t["rationale"], t["fixes"], no_text, t["complexity"],
            t["breaking"], t["testing"]),
        F.when(
            t["purpose"].isNotNull(),
            typed(RECORD_TYPE["context"].dataType,
                  t["purpose"], t["flow"], t["present"], t["missing"], t["file_purpose"], t["framework"])),
        F.lit(None),
        F.lit(None),
        t["agent"],
        item["generated_at"],
    )


def summary_text(record: Column) -> Column:
    """A short plain-text account of a record."""
    d, r, a = record["detection"], record["risk"], record["attack"]
    c, m, f = record["confidence"], record["remediation"], record["false_positive"]

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    def listed(values: Column) -> Column:
        return F.array_join(values, ", ")

    return F.concat_ws(
        "\n",
        line("Finding", d["pattern_matched"]),
        line("Method", d["detection_method"]),
        line("Signals", listed(d["signals_observed"])),
        line("Risk", r["severity_reasoning"]),
        line("Impact", r["impact_description"]),
        line("Assets", listed(r["affected_assets"])),
        line("Attack", a["attack_vector"]),
        line("Exploitability", a["exploitability_rating"]),
        line("Access", a["required_access"]),
        line("Confidence", c["confidence_level"]),
        line("Factors", listed(c["primary_factors"])),
        F.when(c["agent_agreement"] > 0,
               line("Agreement", F.concat(c["agent_agreement"].cast("string"), F.lit(f" of {MAX_AGENTS} reviewers")))),
        line("Fix", m["recommended_fix"]),
        line("Rationale", m["fix_rationale"]),
        line("Complexity", m["implementation_complexity"]),
        F.when(f.isNotNull(),
               line("False positive", F.when(f["is_likely_false_positive"], F.lit("likely")).otherwise(F.lit("unlikely")))),
        F.when(f.isNotNull(), line("Assessment", f["reasoning"])),
    )


def to_json(record: Column) -> Column:
    """JSON without the empty parts."""
    return F.to_json(record)


def from_json(text: Column) -> Column:
    return F.from_json(text, RECORD_TYPE)
