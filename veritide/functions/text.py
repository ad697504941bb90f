"""Text columns: pattern redaction, tokens, snippets, labels, escapes. All built-in expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Redaction patterns by kind, applied in this order. (?U) gives \b, \d and \w their Unicode meaning.
_SUFFIX = "Lane|Ln|Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Place|Pl"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?<!\d)(?:\(\d{3}\)[ ]?\d{3}[-.]\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|\d{10})(?!\d)"
ADDRESS = rf"(?iuU)\b\d{{1,6}}\s+(?:[A-Za-z]+\s+){{1,4}}(?:{_SUFFIX})\b\.?(?:,\s*[A-Za-z][A-Za-z .]*,\s*[A-Z]{{2}}\s*\d{{5}}(?:-\d{{4}})?)?"
# Words that don't count in retrieval.
STOP_WORDS = """a about above after again against all also am an and any are as at be because been before being below between both but
by can cannot could did do does doing down during each few for from further get gets got had has have having he her here hers herself him
himself his how i if in into is it its itself just like me more most much my myself no nor not now of off on once one only or other our
ours ourselves out over own same say says said she should so some such than that the their theirs them themselves then there these they
this those through to too under until up us very was we were what when where which while who whom why will with would you your yours
yourself yourselves""".split()


def name_parts(name: Column) -> Column:
    """Patterns of one name: all its parts in order, `Last, First` of the outer parts, and the last part alone if hyphenated."""
    q = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: p != "")
    quoted, last = F.transform(parts, q), F.element_at(parts, -1)
    return F.array_compact(F.array(
        F.when(F.size(parts) > 0, F.array_join(quoted, r"\s+")),
        F.when(F.size(parts) > 1, F.concat(q(last), F.lit(r"\s*,\s*"), q(parts[0]))),
        F.when((F.size(parts) > 1) & last.contains("-"), q(last))))


def name_pattern(names: list[str]) -> str | None:
    """All names as one pattern: the full name, `Last, First`, and a hyphenated last part alone. None for no names.

    Alternatives are grouped by their first word, so a place in a text is tried against each word once, not against each name;
    longer ones come first.
    """
    import re

    tails: dict[str, set[str]] = {}
    for n in names:
        parts = [re.escape(p) for p in n.split()]
        if parts:
            tails.setdefault(parts[0], set()).add("".join(rf"\s+{p}" for p in parts[1:]))
        if len(parts) > 1:
            tails.setdefault(parts[-1], set()).add(rf"\s*,\s*{parts[0]}")
            if "-" in n.split()[-1]:
                tails[parts[-1]].add("")
    long_first = lambda xs: sorted(xs, key=lambda x: (-len(x), x))
    alts = [f"{h}(?:{'|'.join(long_first(tails[h]))})" for h in long_first(tails)]
    return rf"(?iuU)\b(?:{'|'.join(alts)})\b" if alts else None


def scrub(c: Column, names: list[str] | Column | None = None) -> tuple[Column, dict[str, Column]]:
    """(text with placeholders, counts by kind). Each kind is counted in what the kinds before it left.

    `names` is a list, or a column with the row's own pattern (null for none).
    """
    counts = {}
    own = names if isinstance(names, Column) else name_pattern(names or [])
    for kind, p in (("EMAIL", EMAIL), ("PHONE", PHONE), ("ADDRESS", ADDRESS), ("NAME", own)):
        if kind == "NAME" and p is not None:
            # The long pattern runs once: its matches are the placeholders that come in addition.
            mark = F.lit(r"\[NAME\]")
            clean = F.coalesce(F.regexp_replace(c, p, F.lit("[NAME]")), c) if isinstance(p, Column) else F.regexp_replace(c, p, "[NAME]")
            counts[kind], c = F.regexp_count(clean, mark) - F.regexp_count(c, mark), clean
            continue
        counts[kind] = F.regexp_count(c, F.lit(p)) if p else F.lit(0)
        c = F.regexp_replace(c, p, f"[{kind}]") if p else c
    return c, counts


def tokens(c: Column) -> Column:
    """Distinct ASCII words and numbers in small letters, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def snippet(line: Column, query: Column, width: int = 300) -> Column:
    """At most `width` characters around the first word of the query that the line holds."""
    at = F.array_min(F.filter(F.transform(query, lambda q: F.instr(F.lower(line), q)), lambda p: p > 0))
    start = F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(1)) - 1 - width // 2, F.length(line) - width))
    return F.when(F.length(line) <= width, line).otherwise(F.trim(F.substring(line, start + 1, F.lit(width))))


def mm_ss(ms: Column) -> Column:
    """`06:58`; minutes run past 59."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def citation_label(source: Column, ref: Column, speaker: bool = False) -> Column:
    """`call <id> at mm:ss[, speaker]` or `case <number> comment <id>`."""
    call = F.concat(F.lit("call "), ref["call_id"], F.lit(" at "), mm_ss(ref["start_ms"]))
    if speaker:
        call = F.concat(call, F.coalesce(F.concat(F.lit(", "), ref["speaker_name"]), F.lit("")))
    return F.when(source == "gong", call).otherwise(F.concat(F.lit("case "), ref["case_number"], F.lit(" comment "), ref["comment_id"]))


def cell(c: Column) -> Column:
    """For a Markdown table: pipes become slashes, line breaks blanks."""
    return F.trim(F.translate(c, "|\r\n", "/  "))


def html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def mail_domain(c: Column) -> Column:
    return F.lower(F.trim(F.substring_index(c, "@", -1)))


def picklist(c: Column) -> Column:
    """`a;b;;a` to [a, b]; [] for null."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != ""))


def whole_or(c: Column, digits: int = 2) -> Column:
    """Whole numbers without decimals, others with `digits`."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.format_string(f"%.{digits}f", c))


def fill(template: str, **values: Column) -> Column:
    """`{{TOKEN}}` places of a template replaced by columns."""
    c = F.lit(template)
    for k, v in values.items():
        c = F.replace(c, F.lit("{{" + k + "}}"), v)
    return c


def json_object(c: Column) -> Column:
    """The text if it is a JSON object as it stands (no fences, no repair), else null."""
    t = F.trim(c)
    return F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)


def embedded_json(c: Column) -> Column:
    """The JSON object from the first brace on, else null."""
    return json_object(F.when(F.contains(c, F.lit("{")), F.substr(c, F.locate("{", c))))
