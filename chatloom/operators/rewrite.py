"""Rule-based text rewriting.

A rule set is a short driver-side list (it is configuration, not data).  It is
compiled once into native ``regexp_replace`` expressions; the rows never leave
the JVM.  Each rule becomes its own projection so a long chain does not
duplicate earlier regex work inside one expression tree.

A large rule set is one expression over arrays of its patterns, whatever its
size: rules run in order over the text so far, and a rule's regex runs only
where the text holds the literal that every match of it must contain.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as _CODES
from re import _parser as _PARSER

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PRIORITY = 100
#: Rule sets of more rules are applied as one expression.
MANY_RULES = 40
DEFAULT_ROLES = ("system",)


@dataclass(frozen=True)
class CompiledRule:
    id: str
    pattern: str  # JVM regex syntax
    replacement: str  # JVM replacement syntax ($n, \$ for a literal dollar)
    roles: tuple[str, ...]
    tokens: tuple  # (("lit", text) | ("grp", n), ...) for other back ends
    source: str = ""  # the pattern as the rule states it
    literal: str | None = None  # text that every match contains


_GROUP = re.compile(r"\\g<([^>]*)>|\\([0-9]{1,2})|\\(.)|([^\\]+)", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "\\": "\\"}


def _template_tokens(rep: str) -> tuple:
    """Python ``re.sub`` replacement template -> literal / group tokens."""
    out = []
    for m in _GROUP.finditer(rep):
        g, num, esc, lit = m.groups()
        if g is not None:
            out.append(("grp", int(g) if g.isdigit() else g))
        elif num is not None:
            out.append(("grp", int(num)))
        elif esc is not None:
            out.append(("lit", _ESCAPES.get(esc, "\\" + esc)))
        else:
            out.append(("lit", lit))
    return tuple(out)


def to_jvm_replacement(tokens) -> str:
    parts = []
    after_group = False
    for kind, v in tokens:
        if kind == "grp":
            parts.append(f"${v}")
        else:
            text = v.replace("\\", "\\\\").replace("$", "\\$")
            # a digit after a group reference would be read as part of its number
            parts.append("\\" + text if after_group and text[:1].isdigit() else text)
        after_group = kind == "grp"
    return "".join(parts)


def to_re2_replacement(tokens) -> str:
    parts = []
    for kind, v in tokens:
        parts.append(f"\\{v}" if kind == "grp" else v.replace("\\", "\\\\"))
    return "".join(parts)


#: An escape, a character class, a named group, a reference to one, a lazy or plain dollar or dot.
_SYNTAX = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?[aiLmsux]+\)|\$", re.S)
# What Python's \s and \w match in text, as members of a JVM character class.
_SPACES = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_WORDS = r"\p{L}\p{N}_"
_CLASS = {"s": _SPACES, "w": _WORDS}
_IN, _OUT = (f"(?<{x}[{_WORDS}])" for x in "=!")
_EDGES = {"\\b": f"(?:{_OUT}(?=[{_WORDS}])|{_IN}(?![{_WORDS}]))", "\\B": f"(?!\\A\\z)(?:{_OUT}(?![{_WORDS}])|{_IN}(?=[{_WORDS}]))"}


def _jvm_pattern(p: str, names: dict[str, int], flags: int = 0) -> str:
    """A Python pattern in JVM syntax with Python's meaning.

    ``(?U)`` gives ``\\d`` its Unicode meaning, ``(?d)`` makes the line feed the
    only line end; ``\\s \\S \\w \\W`` become explicit classes, ``\\b \\B $``
    explicit looks to either side, for the JVM's differ.
    """
    multiline = bool(flags & re.MULTILINE)

    def in_class(body: str) -> tuple[str, list[str]]:
        """Class members, and the negated families, which only an alternative can hold."""
        negated: list[str] = []

        def member(c: re.Match) -> str:
            found = c.group(0)
            if found in ("\\s", "\\w"):
                return _CLASS[found[1]]
            if found == "\\b":  # a backspace
                return "\\x08"
            if found in ("\\S", "\\W"):
                negated.append(f"[^{_CLASS[found[1].lower()]}]")
                return ""
            return found if found[0] == "\\" else "".join("\\" + x for x in found)

        return re.sub(r"\\.|\[|&&|^\]", member, body, flags=re.S), negated

    def translate(m: re.Match) -> str:
        found, name, back = m.group(0), m.group(1), m.group(2)
        if name:  # names on the JVM have no underscore
            return f"(?<g{names[name]}>"
        if back:
            return f"\\k<g{names[back]}>"
        if found.startswith("(?"):  # flags stand in front, in the JVM's letters
            return ""
        if found == "\\Z":
            return "\\z"
        if found in _EDGES:
            return _EDGES[found]
        if found == "$":
            return "(?=\\n|\\z)" if multiline else "(?=\\n?\\z)"
        if found in ("\\s", "\\w"):
            return f"[{_CLASS[found[1]]}]"
        if found in ("\\S", "\\W"):
            return f"[^{_CLASS[found[1].lower()]}]"
        if found[0] != "[":
            return found
        negated = found[1] == "^"
        body, families = in_class(found[2 if negated else 1:-1])
        if not families:
            return "[" + "^" * negated + body + "]"
        union = "|".join(([f"[{body}]"] if body else []) + families)
        return f"(?:(?!{union})(?s:.))" if negated else f"(?:{union})"

    letters = "".join(letter for letter, flag in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if flags & flag)
    return f"(?Ud{letters + 'u' * ('i' in letters)})" + _SYNTAX.sub(translate, p)


def required_literal(pattern: str, flags: int = 0) -> str | None:
    """The longest run of characters that every match must contain, if one is told by the pattern's plain sequence."""
    runs, run = [], []

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            if op is _CODES.LITERAL:
                run.append(chr(value))
                continue
            if op is _CODES.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
                continue
            if op is _CODES.AT:  # takes no character
                continue
            if op in (_CODES.MAX_REPEAT, _CODES.MIN_REPEAT) and value[0] >= 1:
                runs.append(run)
                run = []
                walk(value[2])  # once at least; what follows need not be next to it
            runs.append(run)
            run = []

    if flags & re.IGNORECASE:
        return None
    walk(_PARSER.parse(pattern, flags & ~re.UNICODE))
    best = "".join(max([*runs, run], key=len))
    return best or None


def _check_on_jvm(spark: SparkSession, rule_id: str, pattern: str) -> None:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException) as e:
        raise ValueError(f"rule {rule_id}: the JVM has no equivalent of its pattern ({pattern})") from e


def compile_rules(rules: list[dict], spark: SparkSession | None = None) -> list[CompiledRule]:
    """Stable sort by priority (missing = 100), drop disabled (missing = enabled)
    and invalid patterns, translate pattern and replacement to the JVM's syntax.

    A valid pattern that cannot be carried over is an error, never dropped."""
    ordered = sorted(rules, key=lambda r: r.get("priority", DEFAULT_PRIORITY))
    out = []
    for r in ordered:
        if not r.get("enabled", True):
            continue
        try:
            plain = re.compile(r["pattern"])
        except re.error:
            continue
        if plain.flags & (re.ASCII | re.LOCALE):
            raise ValueError(f"rule {r['id']}: patterns with ASCII or locale flags are not carried over")
        names = dict(plain.groupindex)
        pat = _jvm_pattern(r["pattern"], names, plain.flags)
        if spark is not None:
            _check_on_jvm(spark, str(r["id"]), pat)
        toks = tuple((kind, names.get(v, v) if kind == "grp" else v) for kind, v in _template_tokens(r.get("replacement", "")))
        out.append(
            CompiledRule(
                id=str(r["id"]),
                pattern=pat,
                replacement=to_jvm_replacement(toks),
                roles=tuple(r.get("target_roles", DEFAULT_ROLES)),
                tokens=toks,
                source=r["pattern"],
                literal=required_literal(r["pattern"], plain.flags),
            )
        )
    return out


def _applies(rule: CompiledRule, role: Column) -> Column:
    if "all" in rule.roles:
        return F.lit(True)
    return role.isin(list(rule.roles))


def _array(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


class _Folded:
    """A rule set as arrays that one expression walks over."""

    def __init__(self, rules: list[CompiledRule]):
        self.rules = rules
        self.patterns, self.replacements = _array([r.pattern for r in rules], "string"), _array([r.replacement for r in rules], "string")
        self.literals = _array([r.literal or "" for r in rules], "string")  # every text contains the empty one

    def positions(self, role: Column | None) -> Column:
        """Numbers of the rules for a role (None: all), in order."""
        if role is None:
            return F.sequence(F.lit(0), F.lit(len(self.rules) - 1))
        of = lambda name: _array([i for i, r in enumerate(self.rules) if "all" in r.roles or name in r.roles], "int")
        chosen = of(None)
        for name in sorted({x for r in self.rules for x in r.roles} - {"all"}):
            chosen = F.when(role == name, of(name)).otherwise(chosen)
        return chosen

    def replace(self, text: Column, i: Column) -> Column:
        return F.when(F.contains(text, F.get(self.literals, i)), F.regexp_replace(text, F.get(self.patterns, i), F.get(self.replacements, i))).otherwise(text)

    def apply(self, text: Column, role: Column) -> Column:
        return F.aggregate(self.positions(role), text, lambda acc, i: self.replace(acc, i))

    def report(self, text: Column) -> Column:
        """(output, flags): the text after all rules, and for each whether it changed anything."""
        def step(acc: Column, i: Column) -> Column:
            def finish(new: Column) -> Column:
                return F.struct(new.alias("output"), F.concat(acc["flags"], F.array(F.coalesce(new != acc["output"], F.lit(False)))).alias("flags"))

            return F.element_at(F.transform(F.array(self.replace(acc["output"], i)), finish), 1)

        start = F.struct(text.alias("output"), F.array().cast("array<boolean>").alias("flags"))
        return F.aggregate(self.positions(None), start, step)


def apply_rules(df: DataFrame, rules, text: str = "text", role: str = "role") -> DataFrame:
    """R2: ordered replace-all on ``text`` for rows whose role is targeted.

    Later rules see earlier output; null text stays null.
    """
    compiled = rules if rules and isinstance(rules[0], CompiledRule) else compile_rules(rules or [], df.sparkSession)
    if len(compiled) > MANY_RULES:
        return df.withColumn(text, _Folded(compiled).apply(F.col(text), F.col(role)))
    out = df
    for r in compiled:
        out = out.withColumn(
            text,
            F.when(_applies(r, F.col(role)) & F.col(text).isNotNull(),
                   F.regexp_replace(F.col(text), r.pattern, r.replacement)).otherwise(F.col(text)),
        )
    return out


def rule_match_report(df: DataFrame, rules, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """R3 (test mode, roles ignored): (per-row output with per-rule changed flags,
    per-rule count of rows the rule changed)."""
    compiled = rules if rules and isinstance(rules[0], CompiledRule) else compile_rules(rules or [], df.sparkSession)
    if len(compiled) > MANY_RULES:
        found = df.withColumn("_r", _Folded(compiled).report(F.col(text)))
        named = F.transform("_r.flags", lambda f, i: F.struct(F.get(_array([r.id for r in compiled], "string"), i).alias("id"), f.alias("matched")))
        per_row = found.select(*df.columns, F.col("_r.output").alias("output"), named.alias("rules_applied"))
        summary = found.select(F.posexplode("_r.flags").alias("no", "changed")).groupBy("no").agg(F.count_if("changed").alias("rows_changed"))
        ids = df.sparkSession.createDataFrame([(i, r.id) for i, r in enumerate(compiled)], "no int, rule_id string")
        return per_row, ids.join(summary, "no", "left").select("rule_id", F.coalesce("rows_changed", F.lit(0)).alias("rows_changed"))
    out = df.withColumn("_out", F.col(text))
    flags = []
    for i, r in enumerate(compiled):
        nxt = F.regexp_replace(F.col("_out"), r.pattern, r.replacement)
        out = out.withColumn(f"_m{i}", F.coalesce(nxt != F.col("_out"), F.lit(False))).withColumn("_out", nxt)
        flags.append(F.struct(F.lit(r.id).alias("id"), F.col(f"_m{i}").alias("matched")))
    per_row = out.select(
        *df.columns, F.col("_out").alias("output"), F.array(*flags).alias("rules_applied") if flags else F.array().alias("rules_applied")
    )
    if not compiled:
        return per_row, df.sparkSession.createDataFrame([], "rule_id string, rows_changed bigint")
    # One aggregation pass with partial (map-side) counts, then a tiny unpivot.
    counts = out.agg(*[F.count_if(F.col(f"_m{i}")).alias(f"c{i}") for i in range(len(compiled))])
    stack = ", ".join(f"'{r.id}', c{i}" for i, r in enumerate(compiled))
    summary = counts.selectExpr(f"stack({len(compiled)}, {stack}) AS (rule_id, rows_changed)")
    return per_row, summary
