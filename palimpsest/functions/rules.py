"""Rule tables: many regular expressions over one column as one fused native projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """label applies where `pattern` is found; `lines` lets ^ match at every line's start."""

    label: str
    pattern: str
    lines: bool = False

    def java(self) -> str:
        return ("(?dm)" if self.lines else "(?d)") + self.pattern

    def re2(self) -> str:
        """The same test for engines without look-behind (existence only)."""
        return ("(?m)" if self.lines else "") + self.pattern.replace(r"(?<!\w)", r"(?:^|[^\w])")


RuleTable = tuple[Rule, ...]


def hits(column: Column, rules: RuleTable) -> Column:
    """Labels of the rules found in a text, in the table's order; null text has none."""
    text = F.coalesce(column, F.lit(""))
    return F.filter(F.array(*[F.when(text.rlike(r.java()), F.lit(r.label)) for r in rules]), lambda x: x.isNotNull())


def votes(column: Column, rules: RuleTable) -> Column:
    """How many rules of a table are found in a text."""
    text = F.coalesce(column, F.lit(""))
    total = F.lit(0)
    for r in rules:
        total = total + text.rlike(r.java()).cast("int")
    return total


# Heuristic signals of Python 2 and 3 sources, searched line by line.
PY2_SIGNALS: RuleTable = tuple(
    Rule(label, pattern, True)
    for pattern, label in [
        (r"^\s*print\s+[^(]", "print statement (no parens)"),
        (r"except\s+\w+(\.\w+)*\s*,\s*\w+", "old-style except (Exception, e)"),
        (r"^\s*exec\s+[^(]", "exec statement"),
        (r"\bunicode\s*\(", "unicode() builtin"),
        (r"\bxrange\s*\(", "xrange() builtin"),
        (r"<>", "<> operator"),
        (r"raise\s+\w+\s*,\s*['\"]", "old-style raise Exception, \"msg\""),
        (r"^\s*0[0-7]+\s*[,)\]]", "old-style octal literal"),
        (r"\.iteritems\s*\(", ".iteritems() (dict method removed in Py3)"),
        (r"\.iterkeys\s*\(", ".iterkeys() (dict method removed in Py3)"),
        (r"\.itervalues\s*\(", ".itervalues() (dict method removed in Py3)"),
        (r"\.has_key\s*\(", ".has_key() (dict method removed in Py3)"),
        (r"\bimport\s+urllib2\b", "import urllib2 (merged into urllib in Py3)"),
        (r"\bimport\s+ConfigParser\b", "import ConfigParser (renamed configparser in Py3)"),
        (r"\bimport\s+Queue\b", "import Queue (renamed queue in Py3)"),
        (r"\bimport\s+cPickle\b", "import cPickle (merged into pickle in Py3)"),
        (r"\bunichr\s*\(", "unichr() builtin (removed in Py3)"),
        (r"\bbasestring\b", "basestring type (removed in Py3)"),
        (r"\braw_input\s*\(", "raw_input() (renamed input() in Py3)"),
        (r"__metaclass__\s*=", "__metaclass__ assignment (old-style metaclass syntax)"),
    ]
)
PY3_SIGNALS: RuleTable = tuple(
    Rule(label, pattern, True)
    for pattern, label in [
        (r"\bprint\s*\(", "print() function call"),
        (r"^\s*async\s+def\s", "async def"),
        (r":\s*\w+\s*->", "-> return type annotation"),
        (r"f['\"].*\{.*\}.*['\"]", "f-string"),
    ]
)
# Patterns of the vote between the two versions; labels double as migration reasons.
PY2_VOTES: RuleTable = (
    Rule("print_statement", r"^\s*print\s+[^(\n]", True),
    Rule("xrange", r"\bxrange\s*\("),
    Rule("raw_input", r"\braw_input\s*\("),
    Rule("iteritems", r"\.iteritems\s*\("),
    Rule("iterkeys", r"\.iterkeys\s*\("),
    Rule("itervalues", r"\.itervalues\s*\("),
    Rule("basestring", r"\bbasestring\b"),
    Rule("unicode", r"\bunicode\b"),
    Rule("long", r"\blong\s*\("),
    Rule("execfile", r"\bexecfile\s*\("),
    Rule("raw_urllib", r"\burllib2\b"),
    Rule("cStringIO", r"\bcStringIO\b"),
    Rule("ConfigParser", r"\bConfigParser\b"),
    Rule("old_raise", r"^\s*raise\s+\w+\s*,", True),
    Rule("old_except", r"^\s*except\s+\w+\s*,\s*\w+\s*:", True),
    Rule("has_key", r"\.has_key\s*\("),
    Rule("unicode_literal", r"(?<!\w)u(['\"])"),
)
PY3_VOTES: RuleTable = (
    Rule("f_string", r"(?<!\w)f(['\"])"),
    Rule("async_def", r"\basync\s+def\b"),
    Rule("await", r"\bawait\b"),
)
# Markers that pair quality looks for, and compatibility calls that may stay.
PAIR_MARKERS: RuleTable = tuple(
    Rule(label, pattern)
    for pattern, label in [
        (r"\bunicode\s*\(", "unicode("),
        (r"\bxrange\s*\(", "xrange("),
        (r"\braw_input\s*\(", "raw_input("),
        (r"\.iteritems\s*\(", ".iteritems("),
        (r"\.itervalues\s*\(", ".itervalues("),
        (r"\.iterkeys\s*\(", ".iterkeys("),
        (r"\.has_key\s*\(", ".has_key("),
        (r"except\s+\w+(?:\.\w+)*\s*,\s*\w+\s*:", "except X, e:"),
        (r"\bbasestring\b", "basestring"),
        (r"\blong\s*\(", "long("),
        (r"\bsix\.PY2\b", "six.PY2"),
        (r"\bsix\.PY3\b", "six.PY3"),
        (r"\binspect\.getargspec\s*\(", "inspect.getargspec("),
        (r"\.assertEquals\s*\(", ".assertEquals("),
        (r"\.assertNotEquals\s*\(", ".assertNotEquals("),
        (r"\.assertAlmostEquals\s*\(", ".assertAlmostEquals("),
        (r"\.assertNotAlmostEquals\s*\(", ".assertNotAlmostEquals("),
        (r"\.failUnlessEqual\s*\(", ".failUnlessEqual("),
        (r"\.failIfEqual\s*\(", ".failIfEqual("),
        (r"\.failUnless\s*\(", ".failUnless("),
        (r"\.failIf\s*\(", ".failIf("),
    ]
)
SIX_MARKERS: RuleTable = tuple(
    Rule(label, pattern)
    for pattern, label in [
        (r"\bsix\.text_type\b", "six.text_type"),
        (r"\bsix\.string_types\b", "six.string_types"),
        (r"\bsix\.binary_type\b", "six.binary_type"),
        (r"\bsix\.moves\b", "six.moves"),
        (r"\bsix\.u\s*\(", "six.u("),
        (r"\bsix\.b\s*\(", "six.b("),
        (r"\bsix\.iteritems\s*\(", "six.iteritems("),
    ]
)
# What a query's code may need, and the after-side that shows the change was made.
QUERY_PATTERNS: RuleTable = (
    Rule("iteritems", r"\.iteritems\s*\("),
    Rule("iterkeys", r"\.iterkeys\s*\("),
    Rule("itervalues", r"\.itervalues\s*\("),
    Rule("xrange", r"\bxrange\s*\("),
    Rule("raw_input", r"\braw_input\s*\("),
    Rule("has_key", r"\.has_key\s*\("),
    Rule("urllib2", r"\burllib2\b"),
    Rule("cStringIO", r"\bcStringIO\b"),
    Rule("basestring", r"\bbasestring\b"),
    Rule("unicode", r"\bunicode\b"),
    Rule("long", r"\blong\b"),
    Rule("print_statement", r"^\s*print\s+[^(\n]", True),
    Rule("assertEquals", r"\.assertEquals\s*\("),
    Rule("assertNotEquals", r"\.assertNotEquals\s*\("),
    Rule("exec_statement", r"^\s*exec\s+", True),
)
AFTER_PATTERNS: RuleTable = (
    Rule("iteritems", r"\.items\s*\("),
    Rule("iterkeys", r"\.keys\s*\("),
    Rule("itervalues", r"\.values\s*\("),
    Rule("xrange", r"\brange\s*\("),
    Rule("raw_input", r"\binput\s*\("),
    Rule("has_key", r"\bin\b"),
    Rule("basestring", r"\bstr\b|\bsix\.string_types\b"),
    Rule("unicode", r"\bstr\b"),
    Rule("long", r"\bint\b"),
    Rule("print_statement", r"^\s*print\s*\(", True),
    Rule("assertEquals", r"\.assertEqual\s*\("),
    Rule("assertNotEquals", r"\.assertNotEqual\s*\("),
    Rule("urllib2", r"\burllib\.request\b"),
)
# Advice for each migration reason.
ADVICE: dict[str, str] = {
    "print_statement": "Convert Python 2 print statements to Python 3 print() calls.",
    "xrange": "Replace xrange with range.",
    "raw_input": "Replace raw_input with input.",
    "iteritems": "Replace dict.iteritems() with dict.items() where appropriate.",
    "iterkeys": "Replace dict.iterkeys() with dict.keys() or direct iteration.",
    "itervalues": "Replace dict.itervalues() with dict.values() where appropriate.",
    "basestring": "Replace basestring checks with str/bytes-aware Python 3 logic.",
    "unicode": "Review unicode handling and convert to Python 3 string semantics.",
    "long": "Python 3 unifies int and long.",
    "execfile": "Replace execfile with explicit file reading and exec or another appropriate mechanism.",
    "raw_urllib": "Review urllib2 usage and migrate to Python 3 urllib modules.",
    "cStringIO": "Replace cStringIO with io.StringIO or io.BytesIO as appropriate.",
    "ConfigParser": "Replace ConfigParser with configparser.",
    "old_raise": "Convert Python 2 raise syntax.",
    "old_except": "Convert Python 2 exception binding syntax.",
    "has_key": "Replace has_key() with membership testing using 'in'.",
    "unicode_literal": "Review Python 2 unicode literal usage.",
}


def before_after(original: Column, migrated: Column) -> Column:
    """Labels whose pattern is in the original and whose after-side is in the migrated text."""
    return F.array_intersect(hits(original, QUERY_PATTERNS), hits(migrated, AFTER_PATTERNS))


def advice(reasons: Column) -> Column:
    """The advice of each reason that has one, in the reasons' order."""
    table = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return F.filter(F.transform(reasons, lambda r: table[r]), lambda x: x.isNotNull())


def rules_sql(column: str, rules: RuleTable) -> str:
    """A DuckDB list of the labels found, for oracles."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    cases = ", ".join(f"CASE WHEN regexp_matches({column}, {quote(r.re2())}) THEN {quote(r.label)} END" for r in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"
