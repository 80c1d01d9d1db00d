"""Personal data in texts: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers in their usual
forms; these base spans always stay. The field labels words by their shapes: it is trained here
on the small table ``LABELLED`` and finds forms no pattern fits, such as ``ann [at] mail [dot]
example [dot] org``, phone numbers without a plus or with marks between their groups, and cards
and addresses written with other separators. A labelled span is added when its content is of its
kind (``_holds``: digits counted, checksum, parts up to 255) and it overlaps no base span.

Words are runs without blanks. Only words near a sign of data - a digit or one of ``@()[]{}+`` -
can be labelled: sequences are the runs of such words with ``AROUND`` more on either side. Their
features are hashed word shapes, with digit counts, of the word and its neighbours, and the words
before. Viterbi decoding goes through all sequences of a window of text at once, in numpy.

A window of text ends outside all sequences, so its labels are those of the whole text, and memory
follows the window and not the text; only a sequence longer than ``WINDOW`` makes a longer window.

Defined cases: a null text is empty and has no spans. Offsets count code points, ends are
exclusive. Rows are read one by one, so repeated rows and ids are fine. Columns ``base`` and
``spans`` are replaced; others may be carried along.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from siltgate.llm.terms import text_bytes
from siltgate.llm.text import BLANKS, LOWER, Hasher, mix, runs, space_table

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Bytes of text whose words are labelled at once.
WINDOW = 1 << 18
#: Words beside a word with a sign that belong to its sequence.
AROUND = 2

# --- base patterns -------------------------------------------------------------------------

# Each pattern is led by a character that begins few searches, so that long runs cost no squares.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, before = 0, 0
    while (at := text.find("@", before)) >= 0:
        own = text[max(end, before) : at]
        start = max(end, before) + len(own.rstrip(_LOCAL))
        before = at + 1
        if start < at and (found := _DOMAIN.match(text, at)):
            end = before = found.end()
            yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap in each kind."""
    found = [(start, 0, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _ADDRESS.finditer(text) if all(map(_small, m.groups()))]
        for kind, pattern, least, most in ((2, _CARD, 12, 19), (3, _PHONE, 9, 15)):
            for m in pattern.finditer(text):
                if least <= m.end() - m.start():
                    digits = "".join(_DIGIT.findall(m.group()))
                    if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                        found.append((m.start(), kind, m.end()))
    return sorted(found)


# --- the conditional random field ----------------------------------------------------------

#: Labels: outside, and the first and further words of each kind.
LABELS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in "BI"))

#: The labelled table: a text a line, with spans as <kind|content>. Fictional data throughout.
LABELLED = """
write to <email|ann.lee [at] mail [dot] example [dot] org> before noon
you can reach <email|tom (at) post (dot) example (dot) com> for more
contact <email|j_smith{at}example.net> or come by
mail me at <email|r.gomez(at)example.org> please
send it to <email|kim[at]mail[dot]example[dot]com> today
schreib an <email|lena (at) beispiel (punkt) example.de> bis morgen
<email|info [at] shop.example.com> answers soon
escribe a <email|luis.perez[at]example.es> por favor
ecrire a <email|marie (at) exemple.example.fr> avant lundi
our address is <email|sales(at)example(dot)co(dot)uk> thanks
old mail <email|bob.9@mail3.example.com> still works
<email|jo.22@mail8.example.com> the on and
by <email|sue@example.org>, who knows
<email|SUE.4@MAIL2.EXAMPLE.COM>!! THE!! AND!!
call <phone|(212) 555-0187> after six
phone <phone|212-555-0143> or write
tel. <phone|555.0102.334> in the office
my number is <phone|(415) 555 0133> now
fax: <phone|0211/5550123> ab acht
new number <phone|646 555 0171> tonight
ruf an: <phone|030 5550 1234> oder schreib
telefono <phone|91 555 01 23> de noche
tel <phone|01 55 50 12 34> le soir
mobile <phone|0044 20 5550 1234> at night
call me on <phone|1-800-555-0199> for free
<phone|+1!! (743)!! 555-0124!!> THE!! AND!! OF!!
de&&& <phone|+1### (136)### 555-0179***> ciudad%%%
| word | <phone|+1 | (523) | 555-0155> | other |
the <phone|+1 (743) 555-0124> and more
reach us: <phone|+44 20 5550 1234> or so
le <phone|+33 1 55 50 12 34> et la
<phone|(310) 555-0110> stnd in the
ou <phone|(663) 555-0169>, et le
card <card|4111.1111.1111.1111> expires soon
paid with <card|4012/8888/8888/1881> last week
card no. <card|5555_5555_5555_4444> is blocked
visa <card|4111:1111:1111:1111> was used
<card|4222222222222> the of
my card is <card|4111 1111 1111 1111> not yours
with <card|5105-1051-0510-5100> on file
no <card|378282246310005> amex and
<card|4111!! 1111!! 1111!! 1111!!> THE!! AND!!
de <card|6011111111111117> en la
host <ip|10[.]20[.]30[.]40> was seen
login from <ip|192[.]168[.]1[.]17> at night
address <ip|198(.)51(.)100(.)23> was used
von <ip|172.16.254.1> kam es
the <ip|152.143.123.131> of on
OF!! <ip|169.122.221.182>!! AND!!
ip <ip|8[.]8[.]4[.]4> resolves
the year 2024 was good
on 2024-01-15 we met
at 12:30 on 03/04/2021 again
version 3.14.2 of the tool
release 10.0.1 and later
pages 12-19 and 33 to 40
Licensed under CC BY-NC 4.0.
the GNU General Public License, version 3.
token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of the
key = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" and in
number 9807915762804490 the of
order 4785380592391139 was sent
a sum of 1,234,567.89 in all
about 12 000 people (in 1999) came
see [12] and [13] there
f(x) = 3 + 4 (mod 5) holds
call f(0) or g(1) in the loop
item 5501 costs 14.99 or 15
the (second) part [sic] of it
(see above) and so on
chapter 4.2.1.3.5 of the book
isbn 978-3-16-148410-0 is old
room 101, floor 3
size 1920x1080 or 640x480
a[i] = b[j] + c
section (a) and section (b) at the (dot) mark
he looked (at) it again
5 + 7 - 2 is 10
lines 100 200 300 400 500
1 2 3 4 5 6 7 8 9 10
2021 2022 2023 were years
in 1914 1918 and 1939 1945 again
list 10,20,30,40 and 1-2-3-4 or 3_4_5_6
part no. 55-0123-44 is out
ratio 3:2 and 16:9
tel aviv (israel) in 2010
on 1.2.2020 and 24.12.2021
"""

_SIGN = space_table(b"0123456789@()[]{}+")
_DIGITS = space_table(b"0123456789")
_LETTERS = space_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_EDGE = space_table(b".,;:!?\"'`#*$%&|<>=~^")  # marks around a word that are no part of its shape
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 57, 65, 97, 97
_CLASS_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_PLAIN = np.uint64(0x7F4A7C15)
_SALTS = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Settings:
    buckets_log2: int = 14
    steps: int = 200
    rate: float = 0.3
    decay: float = 0.002


@dataclass(frozen=True)
class Words:
    """The words of a window that lie in sequences, and where each sequence begins among them."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    features: np.ndarray  # words x kinds of features
    first: np.ndarray


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for every start, as many as its length says."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher):
    """Per word: hash of its shape with runs as one, of its shape in full, and its digits."""
    lengths = ends - starts
    place = _ranges(starts, lengths)
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(starts)), lengths)
    raw = data[place]
    digits = np.bincount(word[_DIGITS[raw]], minlength=len(starts))
    inner = np.flatnonzero(~_EDGE[raw])
    low, high = first.copy(), first + lengths  # the part between edge marks, or all of a word of marks
    if len(inner):
        owner = word[inner]
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        low[owner[at]], high[owner[at]] = inner[at], inner[np.append(at[1:], len(inner)) - 1] + 1
    classes = _CLASS[raw]
    powers, _ = hasher.powers(len(classes) + 1)
    full = hasher.between(Hasher.prefix_of(_CLASS_VALUES[classes], powers), low, high)
    fresh = np.append(True, classes[1:] != classes[:-1]) if len(classes) else np.zeros(0, bool)
    fresh[low[low < len(classes)]] = True
    index = np.concatenate(([0], np.cumsum(fresh)))
    runs_only = hasher.between(Hasher.prefix_of(_CLASS_VALUES[classes[fresh]], powers), index[low], index[high])
    return runs_only, full, digits


def _sequences(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, buckets_log2: int) -> Words:
    """Words in sequences, with hashed features."""
    starts, ends, _ = runs(~BLANKS[data], offsets)
    signs = np.concatenate(([0], np.cumsum(_SIGN[data])))
    signed = signs[ends] > signs[starts]
    row = np.searchsorted(offsets, starts, "right") - 1
    active = signed.copy()
    for k in range(1, AROUND + 1):
        near = row[k:] == row[:-k]
        active[k:] |= signed[:-k] & near
        active[:-k] |= signed[k:] & near
    chosen = np.flatnonzero(active)
    if not len(chosen):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros((0, 0), np.int64), np.zeros(1, np.int64))
    begins = np.append(True, (np.diff(chosen) > 1) | (row[chosen[1:]] != row[chosen[:-1]]))
    first = np.append(np.flatnonzero(begins), len(chosen))
    starts, ends, row, signed = starts[chosen], ends[chosen], row[chosen], signed[chosen]

    short, full, digits = _shapes(data, starts, ends, hasher)
    short, full = np.where(signed, short, _PLAIN), np.where(signed, full, _PLAIN)
    lowered = LOWER[data]
    letters = np.concatenate(([0], np.cumsum(_LETTERS[data])))
    word = hasher.between(hasher.prefix(lowered), starts, ends)
    word = np.where(letters[ends] > letters[starts], word, _PLAIN)

    def beside(values: np.ndarray, step: int) -> np.ndarray:
        """The value ``step`` words on; beyond a sequence's ends all words are plain."""
        out = np.full(len(values), _PLAIN, dtype=np.uint64)
        sequence = np.cumsum(begins)
        if step < 0:
            same = sequence[-step:] == sequence[:step]
            out[-step:][same] = values[:step][same]
        else:
            same = sequence[step:] == sequence[:-step]
            out[:-step][same] = values[step:][same]
        return out

    count = np.minimum(digits, 24).astype(np.uint64)
    around = [beside(short, k) for k in (-2, -1, 1, 2)]
    close = [beside(full, k) for k in (-1, 1)]
    context = [np.where(signed, beside(word, k), _PLAIN) for k in (-1, -2)]
    kinds = [np.full(len(starts), _PLAIN), short, full, count + np.uint64(1), *around, *close]
    kinds += [mix(short ^ x + np.uint64(7)) for x in around] + [mix(full ^ x + np.uint64(9)) for x in close] + context
    hashed = [mix(x ^ salt) >> np.uint64(64 - buckets_log2) for x, salt in zip(kinds, _SALTS)]
    return Words(starts, ends, row, np.stack(hashed, axis=1).astype(np.int64), first)


def _ordered(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequences from the longest on: where they begin, how long they are, how many last beyond each step."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, size = first[:-1][order], sizes[order]
    steps = int(size[0]) if len(size) else 0
    return begin, size, np.searchsorted(-size, -np.arange(steps), "left").tolist()


def viterbi(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The labels of the best path through each of several sequences laid end to end."""
    begin, size, active = _ordered(first)
    labels = np.zeros(len(scores), dtype=np.int64)
    back = np.zeros(scores.shape, dtype=np.int8)
    state = np.zeros((len(size), scores.shape[1]))
    for t, k in enumerate(active):
        if t:
            paths = state[:k, :, None] + transitions
            back[begin[:k] + t] = paths.argmax(axis=1)
            state[:k] = paths.max(axis=1)
        state[:k] += scores[begin[:k] + t]
    at = state.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        labels[begin[:k] + t] = at[:k]
        at[:k] = back[begin[:k] + t, at[:k]]
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def expectations(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and expected numbers of label pairs, by forward-backward."""
    begin, size, active = _ordered(first)
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    for t, k in enumerate(active):
        at = begin[:k] + t
        forward[at] = scores[at] + (_log_sum(forward[at - 1][:, :, None] + transitions, 1) if t else 0)
    for t in range(len(active) - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        backward[at] = _log_sum(transitions + (scores[at + 1] + backward[at + 1])[:, None, :], 2)
    total = np.repeat(_log_sum(forward[first[1:] - 1], 1), np.diff(first))
    pairs = np.zeros_like(transitions)
    inner = np.ones(len(scores), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    if len(at):
        both = forward[at - 1][:, :, None] + transitions + (scores[at] + backward[at])[:, None, :]
        pairs = np.exp(both - total[at][:, None, None]).sum(axis=0)
    return np.exp(forward + backward - total[:, None]), pairs


def labelled_lines(table: str = LABELLED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans as start, end, kind) of each line of a labelled table."""
    lines = []
    for line in filter(None, table.split("\n")):
        text, spans = "", []
        for before, kind, content in re.findall(r"([^<]*)(?:<(\w+)\|([^>]*)>)?", line):
            text += before
            if kind:
                spans.append((len(text), len(text) + len(content), kind))
            text += content
        lines.append((text, spans))
    return lines


def train(lines: list[tuple[str, list[tuple[int, int, str]]]], settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """(weights of buckets x labels, transitions): the likelihood's ascent over all lines at once."""
    hasher = Hasher()
    data, offsets = text_bytes(pa.array([text for text, _ in lines], pa.large_string()))
    words = _sequences(data, offsets, hasher, settings.buckets_log2)
    weights = np.zeros((1 << settings.buckets_log2, len(LABELS)))
    transitions = np.zeros((len(LABELS), len(LABELS)))
    if not len(words.starts):
        return weights.astype(np.float32), transitions
    gold = np.zeros(len(words.starts), dtype=np.int64)
    for row, (text, spans) in enumerate(lines):
        for start, end, kind in spans:
            low, high = (int(offsets[row]) + len(text[:x].encode()) for x in (start, end))
            inside = np.flatnonzero((words.starts < high) & (words.ends > low))
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[:1]] = LABELS.index(f"B-{kind}")
    seen = np.zeros_like(transitions)
    inner = np.setdiff1d(np.arange(1, len(gold)), words.first)
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    wanted = np.eye(len(LABELS))[gold]
    squares_w, squares_t = np.full(weights.shape, 1e-6), np.full(transitions.shape, 1e-6)
    used = np.unique(words.features)
    for _ in range(settings.steps):
        scores = weights[words.features].sum(axis=1)
        found, pairs = expectations(scores, words.first, transitions)
        gradient = np.zeros_like(weights)
        np.add.at(gradient, words.features, (wanted - found)[:, None, :])
        gradient = gradient[used] - settings.decay * weights[used]
        squares_w[used] += gradient**2
        weights[used] += settings.rate * gradient / np.sqrt(squares_w[used])
        gradient = seen - pairs - settings.decay * transitions
        squares_t += gradient**2
        transitions += settings.rate * gradient / np.sqrt(squares_t)
    return weights.astype(np.float32), transitions


def _windows(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of bytes that end between rows or outside all sequences."""
    begin, total = int(offsets[0]), int(offsets[-1])
    while begin < total:
        end, reach = min(begin + limit, total), limit
        while end < total and (cut := _quiet_place(data, offsets, begin, end)) is None:
            reach *= 2
            end = min(begin + reach, total)
        yield begin, end if end == total else cut
        begin = end if end == total else cut


def _quiet_place(data: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> int | None:
    """The last place up to ``end`` where a row begins or no sequence can go on, if there is one."""
    row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
    if row > begin:
        return row
    # words without a sign, as many as two sequences take on their sides, and the middle between them
    starts, ends, _ = runs(~BLANKS[data[begin:end]], np.array([0, end - begin]))
    starts, ends = starts[:-1], ends[:-1]  # the last word may go on
    signs = np.concatenate(([0], np.cumsum(_SIGN[data[begin:end]])))
    quiet = np.concatenate(([0], np.cumsum(signs[ends] == signs[starts])))
    need = 2 * AROUND + 2
    calm = np.flatnonzero(quiet[need:] - quiet[:-need] == need)
    return begin + int(starts[calm[-1] + need // 2]) if len(calm) and calm[-1] + need // 2 > 0 else None


# --- spans of labelled words ---------------------------------------------------------------

_AT = re.compile(r"\s*[(\[{]\s*at\s*[)\]}]\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*[(\[{]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}]\s*", re.IGNORECASE)
_EMAIL_FORM = re.compile(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+")
_ADDRESS_FORM = re.compile(r"[0-9]+(?:[^\w\s.]*\.[^\w\s.]*[0-9]+){3}")
_LEAD, _TAIL = " .,;:!?\"'`#*$%&|<>=~^)]}-_/", " .,;:!?\"'`#*$%&|<>=~^([{+-_/"


def _holds(kind: int, content: str) -> bool:
    """Whether a labelled span's content is of its kind."""
    if len(content) > 120:
        return False
    if kind == 0:
        return _EMAIL_FORM.fullmatch(_AT.sub("@", _DOT.sub(".", content))) is not None
    groups = re.findall("[0-9]+", content)
    digits = "".join(groups)
    if kind == 1:
        return _ADDRESS_FORM.fullmatch(content) is not None and all(map(_small, groups))
    if re.search(r"[^\W\d_]", content):  # letters
        return False
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(groups) > 1


def _merged(text: str, base: list[tuple[int, int, int]], labelled: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and labelled ones that hold data of their kind and overlap none."""
    starts, reach, found = [start for start, _, _ in base], [], []
    for _, _, end in base:
        reach.append(max(end, reach[-1] if reach else 0))
    for start, kind, end in labelled:
        content = text[start:end].lstrip(_LEAD)
        start = end - len(content)
        end = start + len(content.rstrip(_TAIL))
        before = bisect_left(starts, end)
        if start < end and not (before and reach[before - 1] > start) and _holds(kind, text[start:end]):
            found.append((start, kind, end))
    return sorted([*base, *found])


def _labelled(data: np.ndarray, offsets: np.ndarray, model, hasher: Hasher, buckets_log2: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(row, spans as first byte, kind, end byte) of a batch's rows that have any, in order of rows."""
    weights, transitions = model
    row, held = -1, []
    for begin, end in _windows(data, offsets, WINDOW):
        inner = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end, "right")] - begin
        words = _sequences(data[begin:end], np.unique(np.concatenate(([0], inner, [end - begin]))), hasher, buckets_log2)
        if not len(words.starts):
            continue
        scores = np.zeros((len(words.starts), len(LABELS)), dtype=np.float32)
        for column in words.features.T:
            scores += weights[column]
        labels = viterbi(scores, words.first, transitions)
        kind = (labels - 1) // 2  # of words with a label other than O
        first = np.zeros(len(labels), dtype=bool)
        first[words.first[:-1]] = True
        goes_on = (labels > 0) & (labels % 2 == 0) & ~first
        goes_on[1:] &= (kind[1:] == kind[:-1]) & (labels[:-1] > 0)
        opens = np.flatnonzero((labels > 0) & ~goes_on)
        last = np.append(np.flatnonzero(~goes_on)[1:], len(labels)) - 1  # of each word that goes on nothing
        last = dict(zip(np.flatnonzero(~goes_on).tolist(), last.tolist()))
        for k in opens.tolist():
            start = int(words.starts[k]) + begin
            own = int(np.searchsorted(offsets, start, "right")) - 1
            if own != row:
                if held:
                    yield row, held
                row, held = own, []
            held.append((start, int(kind[k]), int(words.ends[last[k]]) + begin))
    if held:
        yield row, held


def find(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """Add ``base`` and ``spans``, lists of (kind, start, end); columns named in ``keep``, or all, are carried."""
    fields = [f for f in df.schema.fields if f.name not in ("base", "spans") and (keep is None or f.name in keep)]
    names = [f.name for f in fields]
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType(fields + [StructField("base", ArrayType(span)), StructField("spans", ArrayType(span))])
    place, buckets_log2 = len(fields), settings.buckets_log2
    # plain arrays of a fixed size
    shared = df.sparkSession.sparkContext.broadcast(model or train(labelled_lines(), settings))
    kind_of = pa.array(KINDS, pa.string())

    def lists(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
        flat = np.array([x for own in rows for x in own], dtype=np.int64).reshape(-1, 3)
        offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
        parts = [kind_of.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["kind", "start", "end"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = batch.column(place)
            base = [base_spans(texts[row].as_py() or "") for row in range(batch.num_rows)]
            spans = list(base)
            data, offsets = text_bytes(texts)
            for row, held in _labelled(data, offsets, shared.value, hasher, buckets_log2):
                first = int(offsets[row])
                points = np.cumsum((data[first : int(offsets[row + 1])] & 0xC0) != 0x80)  # code points up to each byte
                held = [(int(points[a - first]) - 1, kind, int(points[b - first - 1])) for a, kind, b in held]
                spans[row] = _merged(texts[row].as_py(), base[row], held)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(place)), lists(base), lists(spans)], [*names, "base", "spans"])

    # columns go by place, so that no name of the input can clash
    read = [*[F.col(f"`{name}`") for name in names], F.col(f"`{text}`")]
    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(read)]).mapInArrow(run, schema)


def listed(spans: str) -> Column:
    """Spans as one text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_of(spans: str, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The text with each span, or run of overlapping spans, as its first kind in brackets."""
    # a span that starts before the reach of the ones before it goes on the same gap
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    whole = F.coalesce(F.col(text), F.lit(""))
    piece = lambda low, high: F.substring(whole, (low + 1).cast("int"), (high - low).cast("int"))

    def step(state, s):
        fresh = s["start"] >= state["at"]
        mark = F.concat(F.lit("["), s["kind"], F.lit("]"))
        out = F.when(fresh, F.concat(state["out"], piece(state["at"], s["start"]), mark)).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    end = F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substring(whole, (state["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return df.withColumn(text, F.when(F.col(text).isNotNull(), end))
