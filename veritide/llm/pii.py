"""Personal information in free text: found, typed and replaced by placeholders, by a skip-chain conditional random field.

The nodes of a text are its words that may be part of a name and its candidates of other items: what fits a shape of an e-mail
address, phone number, identity number or street address, and any other long number. Labels are the five types and none. Nodes
have features (shape, label word, register, spelling, words around); edges tie neighbours, equal tokens and similar tokens of a
text, however distant, and loopy message passing makes their labels agree: a clear mention settles a doubtful one. Weights of
features and edges are fitted together, by pseudo-likelihood, on a bounded sample in which the register gives the labels of
names and the shapes those of other items; half of the fit has no register, so unregistered people are found by what is around.

Scanning is one pass in Arrow batches without shuffle; the field of a whole batch is solved at once in numpy. The register
travels with the model up to `max_register` names, beyond it words are looked up by a join (`flagged`), with the same result.

Defined results: null, empty and blank texts have no items; an empty register leaves shapes and context; offsets are code
points of the text as given; overlapping candidates keep the first pattern (e-mail, identity number, address, phone); bank
account numbers are no items; texts of any length are scanned whole; repeated rows give their rows each.
"""
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Titles, particles of surnames, and words that make a name that of an organisation, room or team.
TITLES = "mr mrs ms miss mx dr prof herr frau mme mlle monsieur madame sr sra srta señor señora sir dame".split()
_TITLES = frozenset(TITLES)
PARTICLES = "de la las los del der den van von zu zur al el da dos das di du le bin ben ter ten".split()
ORGANISATION = """academy alliance association bank bureau campaign centre center choir church club college committee company co corp council credit desk
federation food forum foundation fund gmbh group guild history hospital inc institute league library limited llc ltd museum network office partners school
society team theatre chamber circle orchestra council trust union university room stiftung verein verband fondation fundación fundação street road avenue""".split()
#: What meeting systems show in place of a person's name.
DEVICES = frozenset("anonymous caller device dial-in extension guest host line mobile moderator participant recorder room speaker table unknown".split())
_STREETS = "street st road rd avenue ave boulevard blvd lane ln drive dr court ct crescent cres terrace ter place pl way square sq close highway hwy parkway pkwy row walk mews grove gardens circle cir trail".split()
_ORGANISATION = frozenset(ORGANISATION) | {w for w in _STREETS if len(w) > 2}


def shapes() -> list[tuple[str, "re.Pattern"]]:
    """(type, pattern) in order of precedence; the group `x` is the item."""
    import regex

    zw = "[\u200b\u200c\u200d\u2060\ufeff\u00ad]*"
    at = rf"(?:{zw}[^\S\r\n]?{zw}[@＠]{zw}[^\S\r\n]?{zw}|[^\S\r\n]?[\[({{]\s?(?:at|ät)\s?[\])}}][^\S\r\n]?|[^\S\r\n](?:at|AT)[^\S\r\n](?=[\w-]+(?:[^\S\r\n](?:dot|DOT)[^\S\r\n][\w-]+)+))"
    dot = rf"(?:{zw}\.{zw}|[^\S\r\n]?[\[({{]\s?(?:dot|punkt)\s?[\])}}][^\S\r\n]?|[^\S\r\n](?:dot|DOT)[^\S\r\n])"
    label = rf"[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_-]|{zw}(?=[\p{{L}}\p{{N}}]))*"
    local = rf"[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}._%+'-]|{zw}(?=[\p{{L}}\p{{N}}._%+'-]))*"
    email = rf"(?<![\p{{L}}\p{{N}}._%+@-])(?P<x>{local}{at}{label}(?:{dot}{label})*{dot}\p{{L}}{{2,}})"
    d, s, h = r"\d", "[ \u00a0\u2009\u202f.-]?", "[-\u2010\u2011\u2012\u2013]"
    number = rf"(?:\p{{Lu}}{{0,3}}{s}\d(?:[\d\p{{Lu}}]|[ \u00a0-](?=[\d\p{{Lu}}]{{1,4}}\b)){{5,16}})"
    word = r"(?:passport|reisepass|passeport|pasaporte|passaporte|driver['’]?s?\s+licen[cs]e|driving\s+licen[cs]e|licen[cs]e|führerschein|dl|ssn|social\s+security|social\s+insurance|my\s+social|national\s+insurance|ni|nino|national\s+id|identity\s+card|id\s+card|personal\s+id|dni|nie|nif|cpf|personalausweis(?:nummer)?|ausweis(?:nummer)?|steuer-?id|sozialversicherungsnummer|numéro\s+de\s+sécu(?:rité\s+sociale)?|nir|tax\s+id)"
    ids = [
        rf"(?i:\b{word})(?:\s*(?i:numbers?|nummer|numéro|número|no\.?|nr\.?|n\.?º|#|is|ist|est|es|card))*\s*[:#]?\s*(?P<x>{number})(?![\p{{L}}\d])",
        rf"(?<![\p{{L}}\d.{chr(92)}-])(?P<x>(?!000|666)\d{{3}}(?:{h}|[ \u00a0])\d{{2}}(?:{h}|[ \u00a0])\d{{4}})(?![\p{{L}}\d]|{h}\d)",
        rf"(?<![\p{{L}}\d-])(?P<x>(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D])(?![\p{{L}}\d])",
        r"(?<![\p{L}\d-])(?P<x>\p{Lu}\d{3}-\d{4}-\d{4})(?![\p{L}\d-])",
    ]
    cap = r"(?:\p{Lu}[\p{L}'’-]*)"
    streets = "|".join(_STREETS)
    flat = r"(?i:flat|apt\.?|apartment|unit|suite|appt\.?|wohnung|piso)\s+\d{1,4}\s?[A-Za-z]?,?\s+"
    sp = r"[^\S\r\n]+"
    addresses = [
        rf"(?<![\p{{L}}\d#.,-])(?P<x>(?:{flat})?\d{{1,5}}[A-Za-z]?{sp}(?:{cap}{sp}){{1,4}}?(?i:{streets})\b\.?)(?!{sp}\p{{Lu}}\p{{Ll}}+{sp}and\b)",
        rf"(?<![\p{{L}}\d#.-])(?P<x>(?:{flat})?\d{{1,4}}(?:{sp}(?:bis|ter))?,?{sp}(?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|square){sp}(?:(?:de|des|du|d['’]|la|le|les|l['’]){sp}?)*{cap})",
        rf"(?<![\p{{L}}])(?P<x>(?i:calle|c/|avenida|avda\.?|plaza|paseo|camino|rua|travessa|via|viale|piazza){sp}(?:(?:de|del|de{sp}la|de{sp}los|da|do|dos|das|della){sp})?{cap}(?:{sp}{cap}){{0,3}},?{sp}(?:n\.?º{sp})?\d{{1,4}})",
        rf"(?<![\p{{L}}-])(?P<x>(?:(?:\p{{Lu}}\p{{Ll}}+er|Alte[rns]?|Neue[rns]?|Am|An{sp}der|Im|Zur?|Obere|Untere|Große|Kleine|Lange|Kurze){sp})?(?:\p{{Lu}}\p{{L}}+(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm)|(?:{cap}{sp})?(?:Straße|Strasse|Str\.|Weg|Platz|Allee)){sp}\d{{1,4}}\s?[a-z]?)(?![\p{{L}}\d])",
        rf"(?<![\p{{L}}-])(?P<x>(?:(?:Am|An{sp}de[rn]|Im|In{sp}der|Auf{sp}de[rm]|Zum|Zur|Unter{sp}den|Hinter{sp}de[rm]|Vor{sp}dem){sp})?{cap}{sp}\d{{1,4}}\s?[a-z]?)(?=,?{sp}\d{{4,5}}{sp}\p{{Lu}}\p{{Ll}})",
        rf"(?<![\p{{L}}])(?P<x>(?i:p\.?\s?o\.?\s+box|postfach){sp}\d{{1,6}})(?!\d)",
    ]
    g, e = "[ \u00a0\u2009\u202f]", "(?![\\p{L}\\d]|[-\u2010\u2011.]\\d)"
    b = "(?<![\\p{L}\\d.+/#-])"
    any_sep = f"(?:{g}|{h}|[./])"
    phones = [
        rf"(?<![\p{{L}}\d.+/#-])(?P<x>\+\d{{1,3}}{any_sep}?(?:\(\d{{1,4}}\){any_sep}?)?\d{{1,5}}(?:{any_sep}?\d{{2,8}}){{1,5}}){e}",
        rf"{b}(?P<x>00\d{{1,3}}{any_sep}\d{{1,5}}(?:{any_sep}\d{{2,8}}){{1,4}}){e}",
        rf"{b}(?P<x>(?:1(?:{g}|{h}|\.))?\(\d{{3}}\){g}?\d{{3}}(?:{g}|{h}|\.)\d{{4}}){e}",
        rf"{b}(?P<x>(?:1(?:{g}|{h}|\.))?\d{{3}}(?P<s>{g}|{h}|\.)\d{{3}}(?P=s)\d{{4}}){e}",
        rf"{b}(?P<x>\(0\d{{1,5}}\){g}?\d{{3,8}}(?:{g}?\d{{3,4}})?){e}",
        rf"{b}(?P<x>0\d{{1,4}}[/]\s?\d{{5,9}}){e}",
        rf"{b}(?P<x>0\d(?:{g}\d{{2}}){{4}}){e}",
        rf"{b}(?P<x>0\d{{2,4}}{g}\d{{3,4}}{g}\d{{3,4}}){e}",
        rf"(?<![\p{{L}}\d.+/#-])(?P<x>[2-9]\d{{2}}[2-9]\d{{6}})(?![\p{{L}}\d]|[-.]\d)",
    ]
    out = [("EMAIL", email), *(("ID", p) for p in ids), *(("ADDRESS", p) for p in addresses), *(("PHONE", p) for p in phones)]
    return [(k, regex.compile(p)) for k, p in out]


#: Words right before a bare number that make it no phone number.
_NO_PHONE = re.compile(r"(?i)(?:case|invoice|order|batch|ticket|sku|row|build|ratio|column|ref|id|number)s?\W{0,3}$")


_AT, _DIGIT = re.compile(r"[@＠]|[\[({]\s?(?:at|ät)\b|\b(?:dot|DOT)\b"), re.compile(r"\d")
_BREAKS = frozenset(".!?\n:;<>()[]|\"“”")
_LABEL_WORD = re.compile(r"[^\W\d_]+")
#: What `redact` leaves is no item.
_PLACEHOLDER = re.compile(r"\[(?:EMAIL|PHONE|ID|ADDRESS|NAME)\]")


def fold(word: str) -> str:
    """Letters without accents and case, without a possessive ending."""
    w = re.sub(r"['’]s$", "", word)
    return "".join(c for c in unicodedata.normalize("NFKD", w.casefold()) if not unicodedata.combining(c)).replace("ø", "o")


def name_parts(name: str) -> tuple[str, tuple[str, ...]] | None:
    """(given name, surname words without particles), folded; None for a blank name."""
    parts = (name or "").split()
    return (fold(parts[0]), tuple(p for p in map(fold, parts[1:]) if p not in PARTICLES)) if parts else None


def read_register(names: Iterable[str]) -> dict[str, set]:
    """Parts of the registered names: given names, surname words, and the full names as label source."""
    full = {p for p in map(name_parts, names) if p}
    return {"given": {g for g, _ in full}, "surname": {w for _, rest in full for w in rest}, "full": full}


LABELS = ("O", "NAME", "EMAIL", "PHONE", "ID", "ADDRESS")
_L = {k: i for i, k in enumerate(LABELS)}
#: Labels a node may take, by its kind.
_MAY = {"word": ("O", "NAME"), "EMAIL": ("O", "EMAIL"), "PHONE": ("O", "PHONE", "ID"), "ID": ("O", "PHONE", "ID"), "number": ("O", "PHONE", "ID"), "ADDRESS": ("O", "ADDRESS")}
_MASK = {k: np.where([x in v for x in LABELS], 0.0, -1e9) for k, v in _MAY.items()}
#: Kinds of edges: neighbours, neighbours with a comma between, equal tokens, similar tokens.
NEXT, COMMA, EQUAL, SIMILAR = range(4)
#: Means of the Gaussian prior of the weights; what the sample shows moves them. All others have mean 0.
_PRIOR = {
    ("bias", "NAME"): -2.0, ("given", "NAME"): 4.0, ("surname", "NAME"): 4.0, ("titled", "NAME"): 2.0, ("organisation", "NAME"): -4.0, ("device", "NAME"): -4.0, ("glued", "NAME"): -4.0, ("after address", "NAME"): -3.0, ("initial", "NAME"): -1.0,
    ("low", "NAME"): -1.0, ("number", "O"): 1.5, ("refused", "O"): 9.0, **{(f"shape={k}", k): 5.0 for k in ("EMAIL", "PHONE", "ID", "ADDRESS")},
}


def _edge_prior() -> np.ndarray:
    """Agreement is likelier than not, most between equal tokens."""
    w = np.zeros((4, len(LABELS), len(LABELS)))
    for kind, c in ((NEXT, 0.5), (COMMA, 0.2), (EQUAL, 3.0), (SIMILAR, 1.0)):
        w[kind] += c * np.eye(len(LABELS))
    for k in range(2, len(LABELS)):  # the same number or address again
        w[EQUAL, k, k] = 4.0
    return w


class _Word:
    """What a spelling is, apart from where it stands; features are ids of the model's index."""

    __slots__ = ("f", "cut", "cap", "initial", "given", "sur", "node", "own", "reg", "prev", "next", "title", "org", "device", "particle", "low", "similar")


class Field:
    """The field of many texts at once: nodes with features, edges, beliefs. Made in the worker from a fitted model."""

    ITERATIONS = 10

    def __init__(self, model: dict):
        import regex

        self.given, self.surname, self.common = model["register"]["given"], model["register"]["surname"], model["common"]
        self.index, self.weights, self.edge = model["index"], model["weights"], model["edge"]
        self.shapes, self.seen, self.learning = shapes(), {}, False
        self.word = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*\.?")
        self.number = regex.compile(r"(?<![\p{L}\d.,+/#-])\d(?:[ .-]?\d){6,13}(?![\p{L}\d]|[.,-]\d)")
        self.account = regex.compile(r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])")

    def _id(self, name: str) -> int:
        if self.learning:
            return self.index.setdefault(name, len(self.index))
        return self.index.get(name, -1)

    def _look(self, w: str, given: bool | None, sur: bool | None) -> _Word:
        x = _Word()
        cut = len(w)
        if w[-1] == "." and cut > 2 and w[:-1].casefold() not in _TITLES:
            cut -= 1
        w = w[:cut]
        x.cut, x.f = cut, fold(w.rstrip("."))
        x.cap, x.initial = w[0].isupper(), len(w) == 2 and w[1] == "." and w[0].isupper()
        x.given = x.f in self.given if given is None else given
        x.sur = x.f in self.surname if sur is None else sur
        x.device = x.f in DEVICES
        x.title, x.org, x.particle, x.low = x.f in _TITLES, x.f in _ORGANISATION and x.cap, x.f in PARTICLES, w[0].islower()
        x.node = x.initial or x.given or x.sur or x.cap and len(x.f) > 1 and not x.title
        plain = x.f in self.common
        own = ["bias", "cap" if x.cap else "low", "w=" + x.f, "end=" + x.f[-3:]]
        own += [n for n, on in (("caps", w.isupper() and len(w) > 2), ("initial", x.initial), ("common", plain), ("hyphen", "-" in w), ("possessive", w[-2:] in ("'s", "’s"))) if on]
        reg = [n for n, on in (("given", x.given), ("surname", x.sur), ("registered low", (x.given or x.sur) and not x.cap)) if on]
        x.own, x.reg = ([i for i in map(self._id, names) if i >= 0] for names in (own, reg))
        x.prev, x.next = self._id("prev=" + x.f), self._id("next=" + x.f)
        x.similar = x.f[:5] if len(x.f) > 5 else x.f
        return x

    def _word(self, w: str, flags: dict | None) -> _Word:
        if flags is None:
            key = w
            given = sur = None
        else:
            f = fold(w.rstrip("."))
            given, sur = f in flags["g"], f in flags["s"]
            key = (w, given, sur)
        x = self.seen.get(key)
        if x is None:
            if len(self.seen) > 200_000:  # only a memo of spellings
                self.seen.clear()
            x = self.seen[key] = self._look(w, given, sur)
        return x

    def candidates(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pattern) of what may be an item other than a name; the first pattern that fits a place has it."""
        taken, out = bytearray(len(text)), []
        at, digit = _AT.search(text), _DIGIT.search(text)
        if digit:
            for m in self.account.finditer(text):
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        for i, (kind, p) in enumerate(self.shapes):
            if not (at if kind == "EMAIL" else digit):
                continue
            for m in p.finditer(text):
                s, e = m.span("x")
                if not any(taken[s:e]):
                    taken[s:e] = b"\1" * (e - s)
                    out.append((s, e, kind, f"pattern={i}"))
        if digit:
            for m in self.number.finditer(text):
                if not any(taken[m.start() : m.end()]):
                    out.append((m.start(), m.end(), "number", ""))
        return sorted(out)

    def graph(self, texts: list[str], flags: list[dict] | None = None, drop: bool = False) -> dict:
        """Nodes and edges of texts; `drop` leaves the register out of the features (not out of the choice of nodes)."""
        flat, sizes, mask, ref, edges, words_of = [], [], [], [], [], []
        const = {n: self._id(n) for n in ("start", "titled", "organisation", "after registered", "before registered", "alone", "last", "short", "refused", "number", "device", "after address", "glued", "run=1", "run=2", "run=3", "in=0", "in=1", "in=2")}

        def add(node, kind, ids):
            ids = [i for i in ids if i >= 0]
            flat.extend(ids)
            sizes.append(len(ids))
            mask.append(_MASK[kind])
            ref.append(node)
            return len(ref) - 1

        for t, text in enumerate(texts):
            spans = self.candidates(text) if text else []
            words: list[tuple[int, int, _Word]] = []
            words_of.append((words, spans))
            if not text:
                continue
            cover = bytearray(len(text))
            for s, e in [x[:2] for x in spans if x[2] != "number"] + [m.span() for p in (_PLACEHOLDER, self.account) for m in p.finditer(text)]:
                cover[s:e] = b"\1" * (e - s)
            f = flags[t] if flags is not None else None
            for m in self.word.finditer(text):
                if not cover[m.start()]:
                    x = self._word(m[0], f)
                    words.append((m.start(), m.start() + x.cut, x))
            n, short = len(words), len(words) <= 4 and len(text) <= 80
            lower = short and n > 1 and not any(x.cap for *_, x in words)
            links = [0] * (n + 1)  # 1: a blank between a word and the one before, 2: a comma and a blank
            for i in range(1, n):
                a, b = words[i - 1][1], words[i][0]
                if (lower or words[i][2].node or words[i - 1][2].node) and 0 < b - a < 3:
                    gap = text[a:b]
                    links[i] = 1 if gap.isspace() and "\n" not in gap and "\r" not in gap else 2 if gap[0] == "," and b - a == 2 and gap[1].isspace() else 0
            addresses = [x[:2] for x in spans if x[2] == "ADDRESS"] + [m.span() for m in _PLACEHOLDER.finditer(text) if m[0] == "[ADDRESS]"]
            place: dict[int, int] = {}
            last: dict[str, tuple[int, str]] = {}
            first: dict[str, int] = {}
            for i, (s, e, x) in enumerate(words):
                if not (x.node or lower and len(x.f) > 1 and not x.title and (i == 0 or links[i])):
                    continue
                prev, after = words[i - 1][2] if i else None, words[i + 1][2] if i + 1 < n else None
                before, behind = text[words[i - 1][1] : s] if i else "", text[e : e + 2]
                ids = list(x.own) if drop else x.own + x.reg
                ids.append(prev.prev if i else self._id("prev=^"))
                ids.append(after.next if after else self._id("next=$"))
                edge = before.strip()[-1:] or ("\n" if "\n" in before else " ")
                ids.append(self._id("gap " + ("0" if edge.isdigit() else edge)))
                if any(0 < s - z < 40 and _BREAKS.isdisjoint(text[z:s].lstrip()) and not ("\n" in text[z:s] and "," in text[z:s]) for _, z in addresses):
                    ids.append(const["after address"])
                ids.append(self._id("then " + behind))
                if i > 1 and prev.low:
                    ids.append(self._id(f"prev2={words[i - 2][2].f} {prev.f}"))
                if i == 0 or not _BREAKS.isdisjoint(before):
                    ids.append(const["start"])
                a = b = i
                while a > 0 and links[a] and words[a - 1][2].cap and i - a < 4:
                    a -= 1
                while b + 1 < n and links[b + 1] and words[b + 1][2].cap and b - i < 4:
                    b += 1
                ids.append(const[f"run={min(3, b - a + 1)}"])
                ids.append(const[f"in={min(2, i - a)}"])
                if short:
                    ids.append(const["short"])
                    if n == 1 and len(text.strip()) == e - s:
                        ids.append(const["alone"])
                if s > 1 and text[s - 1] in "-/#_" and text[s - 2].isalnum() or e + 1 < len(text) and text[e] in "-/#_" and text[e + 1].isdigit():
                    ids.append(const["glued"])
                if not text[e:].strip():
                    ids.append(const["last"])
                if not drop:
                    if prev and links[i] and (prev.given or prev.sur):
                        ids.append(const["after registered"])
                    if after and links[i + 1] and (after.given or after.sur):
                        ids.append(const["before registered"])
                if prev and prev.title:
                    ids.append(const["titled"])
                if x.org or any(words[k][2].org for k in range(i + 1, b + 1)) or links[i] and not x.given and prev.org and not (x.sur and not drop):
                    ids.append(const["organisation"])
                if x.device or after and links[i + 1] and after.device:
                    ids.append(const["device"])
                k = place[i] = add((t, i), "word", ids)
                if links[i] and i - 1 in place:
                    edges.append((place[i - 1], k, NEXT if links[i] == 1 else COMMA))
                # Equal and similar words: each is tied to the one before it and to the first, so edges grow with the words.
                if not x.initial and len(x.f) > 2:
                    if x.f in last:
                        edges.append((last[x.f][0], k, EQUAL))
                        if first[x.f] != last[x.f][0]:
                            edges.append((first[x.f], k, EQUAL))
                    elif len(x.f) > 4 and "~" + x.similar in last:
                        edges.append((last["~" + x.similar][0], k, SIMILAR))
                    first.setdefault(x.f, k)
                    last[x.f] = last["~" + x.similar] = (k, x.f)
            for s, e, kind, pattern in spans:
                head = text[max(0, s - 24) : s]
                label = _LABEL_WORD.findall(head)
                ids = [self._id("label=" + fold(label[-1])) if label else -1]
                if kind == "number":
                    ids.append(const["number"])
                else:
                    ids += [self._id("shape=" + kind), self._id(pattern)]
                if kind in ("PHONE", "number") and text[s:e].isdigit() and _NO_PHONE.search(head[-14:]):
                    ids.append(const["refused"])
                k = add((t, s, e), kind, ids)
                key = "#" + "".join(c for c in text[s:e].casefold() if c.isalnum())
                if key in last:
                    edges.append((last[key][0], k, EQUAL))
                last[key] = (k, key)
        return {"flat": np.array(flat, np.int64), "size": np.array(sizes, np.int64), "mask": np.array(mask).reshape(len(ref), len(LABELS)), "ref": ref, "edges": np.array(edges, np.int64).reshape(-1, 3), "words": words_of}

    def unary(self, g: dict) -> np.ndarray:
        return g["mask"] + _gather(self.weights, g["flat"], g["size"])

    def spans(self, texts: list[str], flags: list[dict] | None = None) -> list[list[tuple[int, int, str]]]:
        """(start, end, type) of the items of each text, in order."""
        g = self.graph(texts, flags)
        best = beliefs(self.unary(g), g["edges"], self.edge, self.ITERATIONS).argmax(axis=1)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        yes: list[set[int]] = [set() for _ in texts]
        for node, label in zip(g["ref"], best):
            if label and len(node) == 2:
                yes[node[0]].add(node[1])
            elif label:
                out[node[0]].append((node[1], node[2], LABELS[label]))
        for t, text in enumerate(texts):
            if yes[t]:
                out[t] += [(s, e, "NAME") for s, e in assemble(text, g["words"][t][0], yes[t])]
        return [sorted(x) for x in out]

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        return self.spans([text or ""])[0]


def _gather(weights: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of the feature rows of each node."""
    total = np.vstack([np.zeros(weights.shape[1]), np.cumsum(weights[flat], axis=0)]) if len(flat) else np.zeros((1, weights.shape[1]))
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


def beliefs(unary: np.ndarray, edges: np.ndarray, edge: np.ndarray, iterations: int) -> np.ndarray:
    """Loopy sum-product in logs over all texts at once: unnormalised log beliefs of every node and label.

    Messages run both ways along every edge, damped by half, until they stand still or `iterations` are over.
    """
    if not len(edges):
        return unary
    src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    pot = np.concatenate([edge[edges[:, 2]], edge[edges[:, 2]].transpose(0, 2, 1)])
    back = np.r_[len(edges) : 2 * len(edges), : len(edges)]
    msg = np.zeros((len(src), unary.shape[1]))

    def total() -> np.ndarray:
        return unary + np.stack([np.bincount(dst, msg[:, k], len(unary)) for k in range(unary.shape[1])], axis=1)

    for _ in range(iterations):
        out = total()[src] - msg[back]
        x = out[:, :, None] + pot
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(np.exp(new) - np.exp(msg)).max()
        msg = 0.5 * msg + 0.5 * new
        if moved < 1e-3:
            break
    return total()


def assemble(text: str, words: list[tuple[int, int, "_Word"]], yes: set[int]) -> list[tuple[int, int]]:
    """Runs of name words to one span each: particles inside or before a surname, initials, and `Surname, Given`."""
    def blank(k: int) -> bool:
        gap = text[words[k - 1][1] : words[k][0]]
        return 0 < len(gap) < 3 and gap.isspace() and "\n" not in gap and "\r" not in gap

    runs, i, n = [], 0, len(words)
    while i < n:
        if i not in yes:
            i += 1
            continue
        j = i
        while True:
            k = j + 1
            while k < n and blank(k) and words[k][2].particle and k not in yes and k - j <= 3:
                k += 1
            if k >= n or k not in yes or not blank(k):
                break
            x, y = words[j][2], words[k][2]
            if y.given and x.sur and not x.given and k == j + 1 and not y.initial and i != j:
                break  # a new name begins: Ruiz Dana would be two people's parts, Dana Ruiz Sam three
            if y.given and x.sur and not x.given and k == j + 1 and not y.initial and not y.sur:
                break
            j = k
        a = i
        while a > 0 and blank(a) and words[a - 1][2].particle and a - 1 not in yes and (words[a][2].sur or words[a - 1][2].low):
            a -= 1
        runs.append((a, j))
        i = j + 1
    merged, skip = [], False
    for x, (a, j) in enumerate(runs):
        if skip:
            skip = False
            continue
        if x + 1 < len(runs):
            c, d = runs[x + 1]
            joint, y = text[words[j][1] : words[c][0]], words[c][2]
            if c == j + 1 and re.fullmatch(r",[^\S\r\n]", joint) and not any(words[k][2].given for k in range(a, j + 1)) and (y.given or y.initial or not y.sur):
                merged.append((a, d))
                skip = True
                continue
        merged.append((a, j))
    out = []
    for a, j in merged:
        if not all(words[k][2].initial for k in range(a, j + 1)):
            s, e = words[a][0], words[j][1]
            out.append((s, e - 2 if text[e - 2 : e] in ("'s", "’s") else e))
    return out


def seeds(field: Field, text: str, words: list, register: dict, flags: dict | None = None) -> dict[int, int]:
    """Labels that the register gives to the words of a text: 1 name, 0 none, absent where it can't tell.

    Sure are words of registered full names and capitalised registered words alone; a name before an organisation's word is
    none. Small letters alone, and initials apart from a name, can't be told.
    """
    n, out = len(words), {}
    blank = lambda k: 0 < k < n and 0 < words[k][0] - words[k - 1][1] < 3 and "\n" not in text[words[k - 1][1] : words[k][0]]
    for i, (_, _, x) in enumerate(words):
        if not (x.given or x.sur):
            if not x.initial:
                out[i] = 0
            continue
        j = i
        while blank(j + 1) and words[j + 1][2].cap and j - i < 4:
            j += 1
        if any(words[k][2].org or words[k][2].device for k in range(i, j + 1)):
            out[i] = 0
        elif x.cap or blank(i + 1) and words[i + 1][2].sur or blank(i) and words[i - 1][2].given or n <= 4:
            out[i] = 1
    for i, (_, _, x) in enumerate(words):
        if x.initial and (blank(i) and out.get(i - 1) == 1 or blank(i + 1) and out.get(i + 1) == 1):
            out[i] = 1
    return out


def train(texts: list[str], register: dict, rounds: int = 40, ridge: float = 0.3, flags: list[dict] | None = None) -> dict:
    """Feature and edge weights together, by penalised pseudo-likelihood: each node given the labels of its neighbours.

    Every text is taken twice, with the register in the features and without, so that context must carry what the register
    does not know. After a first fit, capitalised words without register that the field itself takes for names (beliefs of
    0.9 or more) become names, as not every person is registered, and the fit goes on.
    """
    low: Counter = Counter()
    for t in texts:
        low.update({fold(w) for w in re.findall(r"(?<!\S)[^\W\d_]{2,}(?=[,.;:!?]*(?:\s|$))", t) if w.islower()})
    model = {"register": register, "common": {w for w, n in low.items() if n > 2}, "index": {}, "weights": np.zeros((0, len(LABELS))), "edge": _edge_prior()}
    field = Field(model)
    field.learning = True
    with_reg, without = field.graph(texts, flags), field.graph(texts, flags, drop=True)
    n = len(with_reg["ref"])
    if not n:
        for f, _ in _PRIOR:
            field._id(f)
    # What a node is by the register or by its shape.
    y, weight, open_ = np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
    known = [seeds(field, t, w, register) for t, (w, _) in zip(texts, with_reg["words"])]
    kinds = [{(s, e): k for s, e, k, _ in spans} for _, spans in with_reg["words"]]
    refused, never = field.index["refused"], {field.index["organisation"], field.index["device"]}
    ends = np.cumsum(with_reg["size"])
    for k, node in enumerate(with_reg["ref"]):
        mine = with_reg["flat"][ends[k] - with_reg["size"][k] : ends[k]]
        if len(node) == 2:
            label = known[node[0]].get(node[1])
            x = with_reg["words"][node[0]][0][node[1]][2]
            if label is None:
                weight[k] = 0
            else:
                y[k] = label
                open_[k] = label == 0 and not (x.given or x.sur) and never.isdisjoint(mine.tolist())
        else:
            kind = kinds[node[0]][node[1:]]
            y[k] = 0 if kind == "number" or refused in mine else _L[kind]
    # A number written like a sure one of the same text is that.
    for _ in range(2):
        for a, b, t in with_reg["edges"]:
            if t == EQUAL and len(with_reg["ref"][a]) == 3:
                y[a], y[b] = y[a] or y[b], y[b] or y[a]
    field.learning = False
    names = {i: f for f, i in field.index.items()}
    mean = np.zeros((len(field.index), len(LABELS)))
    for (f, label), v in _PRIOR.items():
        if f in field.index:
            mean[field.index[f], _L[label]] = v
    spelt = np.array([names[i].startswith(("w=", "end=")) for i in range(len(names))], bool) if names else np.zeros(0, bool)
    flat, size = np.r_[with_reg["flat"], without["flat"]], np.r_[with_reg["size"], without["size"]]
    mask = np.vstack([with_reg["mask"], without["mask"]])
    edges = np.vstack([with_reg["edges"], without["edges"] + [n, n, 0]])
    owner = np.repeat(np.arange(2 * n), size)
    w, edge, prior = mean.copy(), model["edge"].copy(), _edge_prior()
    gw, ge = np.full_like(w, 1.0), np.full_like(edge, 1.0)
    used = np.ones(len(flat), bool)

    def descend(rounds: int) -> None:
        nonlocal w, edge, gw, ge, used
        both, wt = np.r_[y, y], np.r_[weight, weight]
        # How a name is spelt must not be learnt by heart, only how other words are.
        used = ~(spelt[flat] & (both == 1)[owner]) if len(flat) else used
        f2, o2 = flat[used], owner[used]
        s2 = np.bincount(o2, minlength=2 * n)
        live = edges[(wt[edges[:, 0]] > 0) & (wt[edges[:, 1]] > 0)]
        a, b, t = live.T
        truth = np.eye(len(LABELS))[both]
        for _ in range(rounds):
            logit = mask + _gather(w, f2, s2)
            np.add.at(logit, a, edge[t, :, both[b]])
            np.add.at(logit, b, edge[t, both[a], :])
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(axis=1, keepdims=True)
            d = (p - truth) * wt[:, None]
            g = np.stack([np.bincount(f2, d[o2, k], len(w)) for k in range(len(LABELS))], axis=1) + ridge * (w - mean)
            h = ridge * len(truth) / 500 * (edge - prior)
            np.add.at(h, (t, slice(None), both[b]), d[a])
            np.add.at(h, (t, both[a], slice(None)), d[b])
            for k in (EQUAL, SIMILAR):
                h[k] = (h[k] + h[k].T) / 2
            gw += g**2
            ge += h**2
            w -= 0.5 * g / np.sqrt(gw)
            edge -= 0.2 * h / np.sqrt(ge)

    if n:
        descend(rounds)
        model["weights"], model["edge"] = w, edge
        field.weights, field.edge = w, edge
        belief = beliefs(field.unary(without), without["edges"], edge, Field.ITERATIONS)
        sure = belief[:, 1] - belief[:, 0] > np.log(9)
        y[open_ & sure] = 1
        descend(rounds // 2)
    else:
        w = mean
    keep = np.abs(w).max(axis=1) > 1e-3 if len(w) else np.zeros(0, bool)
    order = np.flatnonzero(keep)
    model["index"] = {names[i]: k for k, i in enumerate(order.tolist())}
    for f, label in _PRIOR:  # features that the sample lacks keep their prior
        if f not in model["index"]:
            model["index"][f] = len(model["index"])
    weights = np.zeros((len(model["index"]), len(LABELS)))
    weights[: len(order)] = w[order]
    for (f, label), v in _PRIOR.items():
        if field.index.get(f, -1) not in set(order.tolist()):
            weights[model["index"][f], _L[label]] = v
    model["weights"], model["edge"] = weights, edge
    return model


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded(texts: pd.Series) -> pd.Series:
    """Distinct folded words of a text."""
    import regex

    word = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*")
    return pd.Series([sorted({fold(w) for w in word.findall(t)}) if isinstance(t, str) else [] for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(names: pd.Series) -> pd.Series:
    """Flagged parts of a name: `g:given`, `s:surname word`."""
    split = [name_parts(x) if isinstance(x, str) else None for x in names]
    return pd.Series([["g:" + p[0], *("s:" + w for w in p[1])] if p else [] for p in split], dtype=object)


def flagged(df: DataFrame, names: DataFrame, text: str, name: str, out: str) -> DataFrame:
    """Adds `out`: which words of each text are registered, as `g:word` and `s:word`. The way for registers of any size.

    Distinct words of distinct texts meet the register in one equi-join by word (one row per registered word, so a frequent
    word is a skewed side that adaptive execution splits), and go back to their texts by a digest of them; nothing is broadcast
    unless Spark's own size check allows it.
    """
    part = names.select(F.explode(_parts(name)).alias("p")).distinct().select(F.substring("p", 3, 1 << 20).alias("w"), F.substring("p", 1, 1).alias("flag"))
    part = part.groupBy("w").agg(F.collect_set("flag").alias("flags"))
    keyed = df.withColumn("__k", F.sha2(text, 256))
    words = keyed.select("__k", F.col(text).alias("t")).where("t is not null").dropDuplicates(["__k"]).select("__k", F.explode(_folded("t")).alias("w"))
    hits = words.join(part, "w").groupBy("__k").agg(F.flatten(F.collect_list(F.transform("flags", lambda f: F.concat(f, F.lit(":"), F.col("w"))))).alias(out))
    return keyed.join(hits, "__k", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop("__k")


def fit(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name", sample: int = 3000, longest: int = 4000, max_register: int = 200_000) -> dict:
    """A field fitted on at most `sample` texts of at most `longest` characters, the first in hash order (the bound).

    Registered names are the labels. Up to `max_register` of them travel with the model; of a longer register only those go
    to the fit whose parts stand in the sample, and `find` looks words up by a join: same result, no broadcast.
    """
    names = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull())
    picked = [r[0] for r in texts.select(F.col(text).alias("t")).where((F.length(F.trim("t")) > 0) & (F.length("t") <= longest)).orderBy(F.xxhash64("t"), "t").limit(sample).collect()]
    rows = [r[0] for r in names.limit(max_register + 1).collect()]
    if len(rows) <= max_register:
        return train(picked, read_register(rows))
    import regex

    word = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*")
    said = names.sparkSession.createDataFrame([(x,) for x in sorted({fold(w) for t in picked for w in word.findall(t)})], "w string")
    part = names.select(F.explode(_parts("name")).alias("p")).distinct().select(F.substring("p", 3, 1 << 20).alias("w"), F.substring("p", 1, 1).alias("flag"))
    known = part.join(F.broadcast(said), "w").distinct().collect()  # at most twice the words of the sample
    by = lambda f: {r.w for r in known if r.flag == f}
    model = train(picked, {"given": by("g"), "surname": by("s"), "full": set()})
    return model | {"register": {"given": set(), "surname": set(), "full": set()}, "names": names}


def _scan(batches: Iterator[pd.DataFrame], model: dict, text: str, by_table: bool) -> Iterator[tuple[pd.DataFrame, list[list[tuple[int, int, str]]]]]:
    field = Field(model)
    for b in batches:
        texts = [t if isinstance(t, str) and t.strip() else "" for t in b[text]]
        at = {t: i for i, t in enumerate(dict.fromkeys(texts))} if not by_table else None
        if at is not None:  # copies within a batch are read once
            found = field.spans(list(at))
            yield b, [found[at[t]] for t in texts]
        else:
            flags = [{k: {w[2:] for w in r if w[0] == k} for k in "gs"} for r in b["__reg"]]
            yield b, field.spans(texts, flags)


def _prepared(df: DataFrame, model: dict, text: str) -> tuple[DataFrame, dict, bool]:
    """The frame to scan and the part of the model that travels."""
    sent = {k: v for k, v in model.items() if k != "names"}
    if "names" not in model:
        return df, sent, False
    return flagged(df, model["names"], text, "name", "__reg"), sent, True


def find(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All columns but `text`, and entity_type, start_char, end_char of each item."""
    keep, schema = [c for c in df.columns if c != text], ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != text)
    src, model, by_table = _prepared(df, model, text)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, found in _scan(batches, sent.value, text, by_table):
            at = [i for i, hits in enumerate(found) for _ in hits]
            if at:
                out = pd.DataFrame({c: b[c].to_numpy(dtype=object)[at] for c in keep}, index=range(len(at)))
                flat = [h for hits in found for h in hits]
                out["entity_type"], out["start_char"], out["end_char"] = [h[2] for h in flat], [h[0] for h in flat], [h[1] for h in flat]
                yield out

    return src.mapInPandas(run, f"{schema}{', ' if schema else ''}entity_type string, start_char long, end_char long")


def redact(df: DataFrame, model: dict, text: str = "text", out: str = "redacted") -> DataFrame:
    """Adds `out`: the text with each item replaced by `[TYPE]`; null for null."""
    keep = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    src, model, by_table = _prepared(df, model, text)
    sent, columns = df.sparkSession.sparkContext.broadcast(model), df.columns

    def one(t, found):
        if not isinstance(t, str):
            return None
        for s, e, kind in reversed(found):
            t = f"{t[:s]}[{kind}]{t[e:]}"
        return t

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, found in _scan(batches, sent.value, text, by_table):
            yield b[columns].assign(**{out: pd.Series([one(t, f) for t, f in zip(b[text], found)], index=b.index, dtype=object)})

    return src.mapInPandas(run, f"{keep}, `{out}` string")


def texts(cases: DataFrame, calls: DataFrame) -> DataFrame:
    """Comment bodies and participant names as (src, record_key, text)."""
    a = cases.select("row_no", F.posexplode(F.transform("comments", lambda x: x.CommentBody)).alias("i", "text")).select(
        F.lit("raw_cases.CommentBody").alias("src"), F.concat_ws(":", F.col("row_no").cast("string"), F.col("i").cast("string")).alias("record_key"), "text")
    b = calls.select("doc_no", F.posexplode(F.transform("participants", lambda x: x["name"])).alias("i", "text")).select(
        F.lit("gong_call.name").alias("src"), F.concat_ws(":", F.col("doc_no").cast("string"), F.col("i").cast("string")).alias("record_key"), "text")
    return a.unionByName(b).where(F.col("text").isNotNull())
