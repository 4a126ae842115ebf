"""Personal data by a semi-Markov conditional random field over candidate segments.

Base spans come from fixed rules. Around digits and at-signs, further candidate segments are made of whole tokens;
features of a whole span (its shape, digit count, checksum, separators, the words before it) score it under each
type, and a semi-Markov dynamic programme chooses boundaries and types of all segments of a region jointly: segments
have at most MAX_TOKENS tokens, everything else is outside. Weights are trained here, by conditional likelihood (forward
and backward sums over all segmentations), on sentences composed below. Base spans stay as they are; the model adds spans
that overlap none of them.

Null and empty texts have no spans. Very long texts are read whole; a region is as long as its candidates reach.
Repeated rows give repeated results. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from quoin.llm.common import annotated

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of a segment; an address of eight groups can take 39 tokens.
MAX_TOKENS = 40
MAX_SPAN = 48
#: A model's span is kept where its score, the log odds against leaving its tokens outside with all else equal, is at least this.
ODDS = math.log(9)

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_tokens = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|[ \t]+")
_trigger = re.compile(r"[0-9][0-9 ().\-:]{5,}[0-9]|[\[({] ?at ?[\])}]|[A-Za-z0-9] at [A-Za-z0-9-]+ dot |[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed rules, leftmost and without overlap within a kind."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _local:
            a -= 1
        m = _domain.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end(), "email"))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    for m in _dotted.finditer(text):
        parts, p = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = p + sum(map(len, parts[i : i + 4])) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in parts[i : i + 4]):
                out.append((p, end, "ip"))
            p = end + 1
    for m in _card.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _phone.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# -- the model -------------------------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches worth a look, with some characters on either side; overlapping ones are joined."""
    out: list[list[int]] = []
    for m in _trigger.finditer(text):
        a, b = max(0, m.start() - 40), min(len(text), m.end() + 40)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tokenised(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _tokens.finditer(text, a, b)]


_cue = re.compile(r"(phone|tel|call|mobile|fax|whatsapp|ring)|(card|visa|mastercard|amex|credit)|(\bip\b|host|server|address)|(mail|contact|write|reach)", re.I)
_shapes = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]* ?(?:[\[({] ?at ?[\])}]| at ) ?[A-Za-z0-9-]+(?: ?(?:[\[({] ?dot ?[\])}]| dot |\.) ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"),
    "card": re.compile(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|[0-9]{14,19}"),
    "phone": re.compile(r"(?:00[1-9][0-9]{0,2}[ .-]?)?\(?0?[0-9]{2,4}\)?(?:[ .-][0-9]{2,5}){1,4}"),
}


def span_features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Names of the features of a whole segment under a type."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    out = [f"{kind}:bias", f"{kind}:n{min(digits, 20)}"]
    if _shapes[kind].fullmatch(s):
        out.append(f"{kind}:shape")
        if kind == "phone":
            seps = {c for c in s if not c.isdigit()}
            out.append(f"{kind}:seps{''.join(sorted(seps))}")
            if 9 <= digits <= 15 and (s[0] == "(" or s.startswith("00") or s[0] == "0" or digits == 10):
                out.append(f"{kind}:dialled")
    else:
        out.append(f"{kind}:noshape")
    if kind == "card":
        plain = "".join(c for c in s if c.isdigit() and c.isascii())
        out.append(f"{kind}:luhn{int(14 <= len(plain) <= 19 and luhn(plain))}")
    before = text[max(0, a - 20) : a]
    if m := _cue.search(before):
        out.append(f"{kind}:cue{m.lastindex}")
    else:
        out.append(f"{kind}:nocue")
    if a and (text[a - 1].isalnum() or text[a - 1] in ".:-+@") or b < len(text) and (text[b].isalnum() or text[b] in "@:") or b + 1 < len(text) and text[b] in ".-" and text[b + 1].isdigit():
        out.append(f"{kind}:touching")
    return out


_at = re.compile(r"(?=[ \[(]at|at )")


def candidates(text: str, toks: list[tuple[int, int]], taken: tuple[list[int], list[int]] = ((), ())) -> Iterator[tuple[int, int, str]]:
    """(first token, token after the last, type) of each segment that could be of the type; none crosses a line's end or meets the taken stretches (starts, ends; sorted, apart)."""
    if not toks:
        return
    low, high = toks[0][0], toks[-1][1]
    part = text[low:high]
    digits = [0, *accumulate(map(str.isdigit, part))]
    colons = [0, *accumulate(map(":".__eq__, part))]
    ats = [0] * (len(part) + 1)
    for m in _at.finditer(part):
        ats[m.start() + 1] = 1
    ats = list(accumulate(ats))
    starts, ends = taken
    for i, (a, _) in enumerate(toks):
        first = text[a]
        if not (first.isalnum() or first in "(:"):
            continue
        k = bisect_right(ends, a)  # the first taken stretch that ends behind a
        wall = starts[k] if k < len(starts) else high
        if wall <= a:
            continue
        letter = first.isalpha()
        for j in range(i + 1, min(len(toks), i + MAX_TOKENS) + 1):
            b = toks[j - 1][1]
            if b - a > MAX_SPAN or b > wall or j - i > 1 and toks[j - 1][0] > toks[j - 2][1]:
                break
            if b - a < 7 or not text[b - 1].isalnum():
                continue
            x, y = a - low, b - low
            if ats[y - 2] - ats[x]:
                yield i, j, "email"
            if colons[y] - colons[x] >= 3:
                yield i, j, "ip"
            if not letter and 7 <= (n := digits[y] - digits[x]) <= 19:
                if n >= 14:
                    yield i, j, "card"
                if n <= 15:
                    yield i, j, "phone"


def lattice(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """Candidate segments with their features."""
    return [(i, j, kind, span_features(text, toks[i][0], toks[j - 1][1], kind)) for i, j, kind in candidates(text, toks)]


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def marginals(n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[float]]:
    """Log partition sum over all segmentations of n tokens, and each segment's posterior."""
    into: dict[int, list[tuple[int, float]]] = {}
    for i, j, w in segments:
        into.setdefault(j, []).append((i, w))
    fwd = [0.0] * (n + 1)
    for j in range(1, n + 1):
        fwd[j] = _lse([fwd[j - 1], *(fwd[i] + w for i, w in into.get(j, ()))])
    out_of: dict[int, list[tuple[int, float]]] = {}
    for i, j, w in segments:
        out_of.setdefault(i, []).append((j, w))
    bwd = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bwd[i] = _lse([bwd[i + 1], *(bwd[j] + w for j, w in out_of.get(i, ()))])
    return fwd[n], [math.exp(fwd[i] + w + bwd[j] - fwd[n]) for i, j, w in segments]


def best(n: int, segments: list[tuple[int, int, float]]) -> list[int]:
    """Indices of the segments of the best segmentation."""
    into: dict[int, list[tuple[int, float, int]]] = {}
    for k, (i, j, w) in enumerate(segments):
        into.setdefault(j, []).append((i, w, k))
    score, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        score[j] = score[j - 1]
        for i, w, k in into.get(j, ()):
            if score[i] + w > score[j]:
                score[j], back[j] = score[i] + w, k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append(back[j])
            j = segments[back[j]][0]
    return out[::-1]


def composed(seed: int = 7, size: int = 260) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with known spans, and look-alikes (order numbers, dates, versions, amounts) with none."""
    rng = random.Random(seed)
    syllables = ["the", "tion", "er", "an", "ou", "ch", "ver", "los", "de", "en", "que", "ber"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return ".".join(body[i : i + 4] for i in range(0, 16, 4))

    made = {
        "email": lambda: f"{word()}{rng.choice([' at ', ' [at] ', ' (at) ', '[at]', '(at)'])}{word()}{rng.choice([' dot ', ' [dot] ', '.', ' (dot) '])}{rng.choice(['com', 'org', 'net', 'de'])}",
        "ip": lambda: rng.choice([":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)), f"2001:db8::{rng.randrange(1, 65536):x}:{rng.randrange(1, 65536):x}"]),
        "card": card,
        "phone": lambda: rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{rng.choice('23456789')}{num(2)}-{num(3)}-{num(4)}", f"0049 {num(3)} {num(7)[:5]}", f"0{num(2)} {num(4)} {num(4)}"]),
    }
    cues = {"email": ["contact", "mail", "write to", "reach me"], "ip": ["host", "server", "IP"], "card": ["card", "visa", "credit card"], "phone": ["call", "tel", "phone", "mobile"]}
    others = [
        lambda: f"order {num(9)}", lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", lambda: f"pages {num(3)}-{num(3)}", lambda: f"{num(3)},{num(3)}.{num(2)}", lambda: f"version {num(1)}.{num(2)}.{num(3)}",
        lambda: f"table {num(2)} {num(4)} {num(4)} {num(3)}", lambda: f"arrived at {word()} dot", lambda: f"{num(16)}", lambda: f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"meet at {word()} at {word()}", lambda: f"key {num(4)} {num(4)} {num(4)} {num(4)}",
    ]
    out = []
    for k in range(size):
        text, spans = f"{word()} {word()} ", []
        if k % 2:
            text += rng.choice(others)()
        else:
            kind = KINDS[k // 2 % 4]
            text += rng.choice(cues[kind]) + rng.choice([" ", ": "])
            piece = made[kind]()
            spans.append((len(text), len(text) + len(piece), kind))
            text += piece
        out.append((f"{text} {word()} {word()}.", spans))
    return out


@lru_cache(maxsize=1)
def trained(rounds: int = 60, rate: float = 0.5, l2: float = 0.01) -> dict[str, float]:
    """Weights by gradient ascent on the conditional likelihood of the composed sentences; the same in every worker."""
    items = []
    for text, spans in composed():
        toks = tokenised(text, 0, len(text))
        segments = lattice(text, toks)
        gold = {k for k, (i, j, kind, _) in enumerate(segments) if (toks[i][0], toks[j - 1][1], kind) in spans}
        items.append((len(toks), segments, gold))
    w: dict[str, float] = {}
    past: dict[str, float] = {}
    for _ in range(rounds):
        g: dict[str, float] = {}
        for n, segments, gold in items:
            _, post = marginals(n, [(i, j, sum(w.get(f, 0.0) for f in fs)) for i, j, _, fs in segments])
            for k, (_, _, _, fs) in enumerate(segments):
                d = (k in gold) - post[k]
                if abs(d) > 1e-4:
                    for f in fs:
                        g[f] = g.get(f, 0.0) + d
        for f, d in g.items():
            d -= l2 * w.get(f, 0.0)
            past[f] = past.get(f, 0.0) + d * d
            w[f] = w.get(f, 0.0) + rate * d / (math.sqrt(past[f]) + 1e-6)
    return w


def apart(base: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover."""
    starts, ends = [], []
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


@lru_cache(maxsize=1)
def _shaped(weights: tuple[tuple[str, float], ...]) -> frozenset[str]:
    """Types of which no segment without the type's shape can score above zero, whatever its other features are."""
    w = dict(weights)
    best_of = lambda names: max((w.get(n, 0.0) for n in names), default=0.0)
    out = set()
    for kind in KINDS:
        top = w.get(f"{kind}:bias", 0.0) + w.get(f"{kind}:noshape", 0.0) + best_of([f"{kind}:n{i}" for i in range(21)])
        top += best_of([f"{kind}:nocue", *(f"{kind}:cue{i}" for i in range(1, 5))]) + max(0.0, w.get(f"{kind}:touching", 0.0))
        top += best_of([f"{kind}:luhn0", f"{kind}:luhn1"]) if kind == "card" else 0.0
        if top <= 0:
            out.add(kind)
    return frozenset(out)


def model_spans(text: str, base: list[tuple[int, int, str]], w: dict[str, float]) -> list[tuple[int, int, str]]:
    """What the model adds beside the base spans."""
    out, taken = [], apart(base)
    shapes = {k: _shapes[k].fullmatch for k in _shaped(tuple(w.items()))} if (found_regions := regions(text)) else {}
    for a, b in found_regions:
        toks = tokenised(text, a, b)
        found = []
        for i, j, kind in candidates(text, toks, taken):
            at, to = toks[i][0], toks[j - 1][1]
            if kind in shapes and not shapes[kind](text, at, to):
                continue
            s = sum(w.get(f, 0.0) for f in span_features(text, at, to, kind))
            if s > 0:  # others never beat leaving their tokens outside
                found.append((i, j, kind, s))
        for k in best(len(toks), [(i, j, s) for i, j, _, s in found]):
            i, j, kind, s = found[k]
            if s >= ODDS:
                out.append((toks[i][0], toks[j - 1][1], kind))
    return out


def spans(text: str, w: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    return base, sorted([*base, *model_spans(text, base, w)], key=lambda s: (s[0], KINDS.index(s[2])))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its type; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text", mask: bool = False, names: tuple[str, str] = ("pii_base", "pii_spans")) -> DataFrame:
    """docs with pii_base and pii_spans (kind:start:end, comma-joined); columns of these names are replaced. The text stays only if mask, masked."""
    weights = trained()

    def worker():
        def found(data: bytes | None) -> tuple:
            s = (data or b"").decode("utf-8", "replace")
            base, every = spans(s, weights)
            got = (listed(base), listed(every))
            return (None if data is None else masked(s, every) if every else s, *got) if mask else got

        return found

    return annotated(docs, text, f"`{text}` string, " * mask + f"`{names[0]}` string, `{names[1]}` string", worker, keep_text=False)
