"""Rule engine: rules are data (id, kind, group, pattern in RE2 syntax, enabled), applied to bodies as expressions."""

from __future__ import annotations

import functools
import os
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import dialect, values

RULES_ENV = "WEBQUARRY_RULES"
# Prefixes of ids and kinds of rules by group, names of rules that have another name in files of groups.
PREFIXES = {"Fingerprint": "fp", "Maybe Vulnerability": "vuln", "Sensitive Information": "sec", "Basic Information": "info", "Other": "other"}
KINDS = {"Maybe Vulnerability": "vuln", "Fingerprint": "fingerprint", "Basic Information": "sensitive", "Sensitive Information": "sensitive", "Other": "fingerprint"}
ALIASES = {
    "shiro": "shiro", "jwt_token": "json-web-token", "swagger_ui": "swagger-ui", "ueditor": "ueditor", "druid": "druid",
    "java_deserialization": "java-deserialization", "debug_logic_params": "debug-logic-parameters", "url_as_value": "url-as-a-value",
    "upload_form": "upload-form", "chinese_idcard": "chinese-idcard", "chinese_mobile": "chinese-mobile-number",
    "internal_ip": "internal-ip-address", "mac_address": "mac-address", "jdbc_connection": "jdbc-connection", "wecom_key": "wecom-key",
    "username_field": "username-field", "password_field": "password-field", "sensitive_field": "sensitive-field", "sourcemap_ref": "source-map",
}
#: Rules without a keyword are tried on every body; a keyword test comes first where a rule has keywords.
EMBEDDED = "embedded"


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    group: str
    pattern: str
    enabled: bool = True
    scope: str = "any"  # read, but of no effect


@dataclass
class RuleSet:
    rules: list[Rule]
    source: str = EMBEDDED
    black_text: tuple[str, ...] = values.BLACK_TEXT
    errors: dict[str, str] = field(default_factory=dict)

    def count(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for r in self.rules:
            found[r.kind] = found.get(r.kind, 0) + 1
        return found


def build(rules: list[Rule], source: str = EMBEDDED) -> RuleSet:
    """Enabled rules with a pattern that RE2 takes; the others are named in errors."""
    found = RuleSet([], source)
    for r in rules:
        if not r.enabled:
            continue
        try:
            if not r.pattern:
                raise dialect.PatternError("empty pattern")
            dialect.java(r.pattern)
        except dialect.PatternError as e:
            found.errors[r.id] = str(e)
        else:
            found.rules.append(r)
    return found


def embedded() -> RuleSet:
    return build([Rule(*r) for r in values.RULES])


def from_yaml(text: str, source: str) -> RuleSet:
    import yaml

    rows = (yaml.safe_load(text) or {}).get("rules") or []
    return build([Rule(str(r.get("id", "")), str(r.get("kind", "")), str(r.get("group", "")), str(r.get("pattern") or ""), r.get("enabled") is not False, str(r.get("scope", "any"))) for r in rows], source)


def to_yaml(rules: RuleSet | Iterable[Rule]) -> str:
    """Rules as the file that from_yaml reads; what is switched off stays so."""
    import yaml

    rows = []
    for r in rules.rules if isinstance(rules, RuleSet) else rules:
        row = {"id": r.id, "kind": r.kind, "group": r.group, "pattern": r.pattern}
        rows.append(row | ({} if r.enabled else {"enabled": False}) | ({} if r.scope == "any" else {"scope": r.scope}))
    return yaml.safe_dump({"rules": rows}, allow_unicode=True, sort_keys=False)


def from_groups(text: str) -> tuple[list[Rule], list[str]]:
    """Rules of a file of named rules in groups (rules: group, rule: name, loaded, f_regex, s_regex, sensitive), and notes on what is left out.

    A rule's id is its group's prefix and its name as a slug; one that is there already gets a number. A second expression is dropped.
    """
    import yaml

    found, notes, used = [], [], Counter()
    for part in (yaml.safe_load(text) or {}).get("rules") or []:
        group = str(part.get("group") or "")
        for row in part.get("rule") or []:
            name, pattern = str(row.get("name") or ""), str(row.get("f_regex") or "")
            where, slugged = f"{group}/{name}", plain_slug(name)
            if not pattern:
                notes.append(f"{where}: left out, no expression")
                continue
            if row.get("s_regex"):
                notes.append(f"{where}: second expression dropped")
            try:
                dialect.java(pattern)
            except dialect.PatternError as e:
                notes.append(f"{where}: left out, {e}")
                continue
            if not slugged:
                notes.append(f"{where}: left out, nothing of its name is left")
                continue
            own = f"{PREFIXES.get(group) or plain_slug(group)}-{slugged}"
            own = f"{own}-{used[own] + 1}" if used[own] else own
            used[own] += 1
            kind = "sensitive" if row.get("sensitive") else KINDS.get(group, "fingerprint")
            found.append(Rule(own, kind, group, pattern, bool(row.get("loaded"))))
    return found, notes


def merged(given: list[Rule], own: list[Rule]) -> list[Rule]:
    """given, and those of own that it doesn't replace (by id without the prefix, by an alias, or by pattern), by group and id, each id once."""
    names, patterns = {bare(r.id) for r in given}, {r.pattern.strip() for r in given}
    kept = [r for r in own if bare(r.id) not in names and r.pattern.strip() not in patterns and ALIASES.get(r.id) not in names]
    once: dict[str, Rule] = {}
    for r in sorted([*given, *kept], key=lambda r: (r.group, r.id)):
        if r.id.strip() and r.pattern.strip():
            once.setdefault(r.id, r)
    return list(once.values())


def bare(rule_id: str) -> str:
    for prefix in PREFIXES.values():
        rule_id = rule_id.removeprefix(f"{prefix}-")
    return rule_id


def plain_slug(name: str) -> str:
    """`slug` of a Python string."""
    return re.sub("-{2,}", "-", re.sub("[^a-z0-9-]", "", re.sub(r"[ ./\\_]", "-", name.lower()))).strip("-")


def user_path() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "webquarry" / "rules.yaml"


def load(flag: str = "", user: Path | None = None) -> RuleSet:
    """Flag, then environment (both must be readable), then the user's file, which is written if it is missing, then the embedded rules. One replaces the others whole."""
    for name, label in ((flag, "flag"), (os.environ.get(RULES_ENV, ""), "env")):
        if name:
            return from_yaml(Path(name).read_text(), f"{label}:{name}")
    user = user or user_path()
    try:
        if not user.exists():
            user.parent.mkdir(parents=True, exist_ok=True)
            user.write_text(to_yaml(embedded()))
        return from_yaml(user.read_text(), f"user:{user}")
    except Exception as e:  # an unreadable user file must not stop a run
        found = embedded()
        found.source = f"embedded(user-fallback: {e})"
        return found


def folded(body):
    """body in lower case, with the sign that RE2 folds to s."""
    return F.translate(F.lower(body), "\u017f", "s")


def matches(body, pattern: str, low=None):
    """Distinct whole matches in order; none for a null body. low: `folded` body, for the gate."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(body, F.lit(dialect.java(pattern)), F.lit(0)), lambda m: m != ""))
    words = dialect.keywords(pattern)
    none = F.array().cast("array<string>")
    if words:
        low = folded(body) if low is None else low
        return F.when(functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), found).otherwise(none)
    return F.coalesce(found, none)


def apply(bodies: DataFrame, rules: RuleSet | None = None, body: str = "body") -> DataFrame:
    """A row for each body and rule that hits: the other columns, rule_id, kind, group, matches. No shuffle.

    A body is folded once; plain searches of it for the rules' keywords decide which patterns are run.
    """
    rules = rules or embedded()
    others = [c for c in bodies.columns if c != body]
    low = "folded"
    while low in bodies.columns:
        low += "_"
    bodies = bodies.withColumn(low, folded(F.col(body)))
    hits = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.group).alias("group"), matches(F.col(body), r.pattern, F.col(low)).alias("matches")) for r in rules.rules])
    return bodies.select(*others, F.explode(F.filter(hits, lambda h: F.size(h["matches"]) > 0)).alias("hit")).select(*others, "hit.*")


def is_black_text(body, texts=values.BLACK_TEXT):
    return F.coalesce(body.rlike(dialect.any_of(texts)), F.lit(False))


def hits_by_kind(hits: DataFrame) -> DataFrame:
    return hits.groupBy("kind").agg(F.count(F.lit(1)).alias("hits"))


def rule_table(spark: SparkSession, rules: RuleSet | None = None) -> DataFrame:
    rules = rules or embedded()
    return spark.createDataFrame([(r.id, r.kind, r.group, r.pattern) for r in rules.rules], "rule_id string, kind string, group string, pattern string")


def slug(name):
    """Lower case, separators as single dashes, nothing else but letters and digits."""
    lowered = F.translate(F.lower(name), " ./\\_", "-----")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9-]", ""), "-{2,}", "-"), F.lit("-"))


def group_prefix(group):
    found = F.lit(None).cast("string")
    for name, short in PREFIXES.items():
        found = F.when(group == name, short).otherwise(found)
    return F.coalesce(found, slug(group))


def inferred_kind(group, sensitive):
    return F.when(sensitive, "sensitive").when(group == "Maybe Vulnerability", "vuln").when(group.isin("Basic Information", "Sensitive Information"), "sensitive").otherwise("fingerprint")
