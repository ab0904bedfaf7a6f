"""Plain Python versions of what the operators compute, for small inputs."""

import re
from itertools import combinations

import regex

from cinderlog.llm import decontam, quality

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WHITE.split(text or "") if w]


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, n=5):
    w = words(lowered(text))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(texts, percent):
    """doc_id to its component, over all pairs."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if not x or not y or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
            continue
        both = len(x & y)
        if 100 * both >= percent * (len(x) + len(y) - both):
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def line_keys(line, depth=3, long=12, stretches=4):
    """The templates a line belongs to: as a whole, and without one stretch."""
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in line.split()]
    if len(tokens) < 4 or not re.search(r"[^\W\d_]", " ".join(tokens).replace("<*>", "")):
        return []
    keys = [("whole", *tokens)]
    if len(tokens) >= long:
        cuts = [depth + (len(tokens) - depth) * k // stretches for k in range(stretches + 1)]
        keys += [
            (k, len(tokens), *tokens[: cuts[k]], "|", *tokens[cuts[k + 1] :])
            for k in range(stretches)
        ]
    return keys


def dropped_lines(texts, min_docs=6):
    """doc_id to the numbers of its lines that recur, by comparing everything with everything."""
    seen = {}
    for d, t in texts.items():
        for no, line in enumerate((t or "").split("\n")):
            for k in line_keys(line):
                seen.setdefault(k, {}).setdefault(t, {}).setdefault(d, []).append(no)
    out = {d: set() for d in texts}
    for places in seen.values():
        if len(places) < min_docs:
            continue
        first = min(min(docs) for docs in places.values())
        for docs in places.values():
            holds = first in docs
            for d, numbers in docs.items():
                out[d] |= set(numbers) - ({min(numbers)} if holds else set())
    return {d: sorted(n) for d, n in out.items()}


def _marked(text):
    """Tokens of a text; names, numbers and units start with a mark and their type."""
    mark, point = "\x01", "\x02"
    text = text.replace(mark, " ").replace(point, " ")
    words = regex.sub(r"(\p{Lu}(?<=[\p{Ll}\p{N}][,;]?[ \n]\p{Lu})\p{Ll}+)", rf" {mark}p\1 ", text)
    if regex.search(r"\p{N}", text):
        words = regex.sub(r"(\p{N}(?<![\p{L}\p{N}]\p{N})[\p{N}.,:/]*(?<=\p{N}))", rf" {mark}n\1 ", words)
        words = regex.sub(decontam.UNIT.replace(r"\x{A0}", "\xa0"), rf"\1{mark}u\2 ", words)
        words = regex.sub(rf"([€$£])(?= {{0,3}}{mark}n)", rf" {mark}u\1 ", words)
        words = regex.sub(r"(?<=\p{N})[.,:/](?=\p{N})", point, words)
    return [t for t in regex.split(rf"[^\p{{L}}\p{{N}}{mark}{point}%°€$£]+", words.lower()) if t]


def _windows(tokens):
    """Place, length, key, values or None, and their places, of every window of a text."""
    n, some = len(tokens), any(t[0] == "\x01" for t in tokens)
    plain = [t[:2] if t[0] == "\x01" else t for t in tokens]
    if 0 < n < 5:
        return [(0, n, (" ", *(t[2:] if t[0] == "\x01" else t for t in tokens)), None, None)]
    out = []

    def literals(i, m):
        return sum(t[0] != "\x01" for t in tokens[i : i + m])

    def add(i, m):
        at = [k for k in range(i, i + m) if tokens[k][0] == "\x01"]
        out.append((i, m, tuple(plain[i : i + m]), [tokens[k] for k in at] if some else None, at))

    for i in range(n - 4):
        if literals(i, 5) >= 3:
            add(i, 5)
            continue
        out.append((i, 5, tuple(tokens[i : i + 5]), None, None))
        after = [m for m in range(6, 14) if i + m <= n and literals(i, m) >= 3]
        before = [m for m in range(6, 14) if i + 5 >= m and literals(i + 5 - m, m) >= 3]
        for m in after[:1]:
            add(i, m)
        for m in before[:1]:
            add(i + 5 - m, m)
    return out


def leaks(docs, items):
    """(doc_id, item_id) to the tokens met, over lists of (id, text), one alignment after the other."""
    parsed = [(b, _marked(t)) for b, t in items if t is not None]
    out = {}
    for d, t in docs:
        seen = {}
        for i, m, key, slots, _ in _windows(_marked(t)) if t is not None else ():
            seen.setdefault(key, []).append((i, m, slots))
        for b, tokens in parsed:
            by_off = {}
            for j, m, key, values, at in _windows(tokens):
                for i, _, slots in seen.get(key, ()):
                    by_off.setdefault(i - j, []).append((j, m, slots, values, at))
            met = {}
            for off, hits in by_off.items():
                votes = {}
                for _, _, slots, values, at in hits:
                    for v, s, k in zip(values or (), slots or (), at or ()):
                        votes.setdefault(v, {}).setdefault(s, set()).add(k)
                chosen = {
                    v: max((len(k), v == s, s) for s, k in kinds.items())[2]
                    for v, kinds in votes.items()
                    if len(kinds) > 1
                }
                for j, m, slots, values, _ in hits:
                    if slots is None or all(chosen.get(v, s) == s for v, s in zip(values or (), slots)):
                        met.setdefault(off, set()).update(range(j, j + m))
            best, chain, last = 0, set(), None
            for off in sorted(met):
                chain = chain | met[off] if last is not None and off - last <= 4 else set(met[off])
                best, last = max(best, len(chain)), off
            if best >= 13 or best and best * 2 >= len(tokens):
                out[d, b] = max(best, out.get((d, b), 0))
    return out


def cleaned(text):
    """What the quality rules leave of a text; None if the document goes."""
    lines, w = (text or "").split("\n"), words(text)

    def fails(line):
        low = line.lower()
        return bool(words(line)) and (
            not re.search(quality.SENTENCE, line, re.ASCII)
            or bool(re.search(quality.DENSE, line))
            or bool(re.search(quality.NAVIGATION, low, re.ASCII))
            or any(p in low for p in quality.BOILERPLATE)
        )

    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    left = [x for x in lines if not fails(x)]
    lost = sum(map(len, w)) - sum(len(x) for line in left for x in words(line))
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w) or 100 * lost > 30 * sum(map(len, w)):
        return None
    return text if len(left) == len(lines) else "\n".join(left)
