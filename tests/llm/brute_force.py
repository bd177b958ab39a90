"""The operators' results by the plainest means, for small inputs."""

import collections
import hashlib
import math
import re
import string

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LAST = 1 << 63


def _id(d):
    return LAST if d is None else d


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def removed(rows, window):
    """Per row: which words lie in windows that a document with a smaller id has."""
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i: i + window])
            first[k] = min(first.get(k, LAST), _id(d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i: i + window])] < _id(d):
                gone[i: i + window] = [True] * window
        out.append((w, gone))
    return out


def substring_rows(rows, window=50):
    out = []
    for (d, _), (w, gone) in zip(rows, removed(rows, window)):
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return in_order(out)


def contamination_rows(rows, items, window=10):
    phrases = {}
    for i, t in items:
        w = _WORDS.findall((t or "").translate(_LOWER))
        for j in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[j: j + window]), set()).add(i)
    lengths = sorted({len(p) for p in phrases})
    out = []
    for d, t in rows:
        w = _WORDS.findall((t or "").translate(_LOWER))
        hit, ids = [False] * len(w), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                found = phrases.get(tuple(w[j: j + n]))
                if found:
                    ids |= found
                    hit[j: j + n] = [True] * n
        listed = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((d, len(w), sum(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), any(hit)))
    return in_order(out)


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1))


def jaccard_rows(rows, share=90, k=3):
    sets = [shingle_set(t, k) for _, t in rows]
    having, parent = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in having[x] if j < i)
        for j, n in common.items():
            if 100 * n >= share * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), LAST), _id(d))
    real = {r: None if d == LAST else d for r, d in least.items()}
    return in_order([(d, len(sets[i]), real[top(i)]) for i, (d, _) in enumerate(rows)])


def code_length(texts, order, text):
    """Bits of ``text`` under escape-coded byte contexts learned from ``texts``."""
    import math
    trees = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in texts:
        data = b"\n" * order + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                trees[k][data[i - k: i]][data[i]] += 1
    bits, data = 0.0, b"\n" * order + text
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = trees[k].get(data[i - k: i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def trie_rows(rows):
    """Nodes of the trie over ``rows (conv_id, turn, role, text)``, one prefix at a time."""
    import zlib
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "",
                           hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = [(x[2], x[4]) for x in sorted(own.get(base, []))[:h] + sorted(own[c])[h:]]
    members = collections.defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(p))
        out.append((convs[0], len(p), members[p[:-1]][0] if p else None, len(convs), children[p],
                    sum(1 for q in below if not children[q]),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return in_order(out)


def alignment_rows(rows, entries_a, entries_b, encode_a, encode_b):
    """Groups by comparing the sets of ends; counts over all links."""
    def spans(ids, entries):
        at, out = 0, []
        for i in ids:
            at += len(entries[i])
            out.append(at)
        return out

    texts, pairs = [], collections.Counter()
    for d, t in rows:
        a, b = (encode_a(t), encode_b(t)) if t else ([], [])
        want = b" " + (t or "").encode()
        if t and (b"".join(entries_a[i] for i in a) != want or b"".join(entries_b[i] for i in b) != want):
            a, b = [], []
        ends_a, ends_b = spans(a, entries_a), spans(b, entries_b)
        links = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f]
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(x) for x, e in zip(a, ends_a) if low < e <= cut) + "|"
                          + ",".join(str(y) for y, f in zip(b, ends_b) if low < f <= cut))
            low = cut
        pairs.update(links)
        texts.append((d, a, b, groups, links))
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return in_order([(d, len(a), len(b), len(g), len(k), sum(pairs[x] == best[x[1]] for x in k),
                      sum(pairs[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
                     for d, a, b, g, k in texts])


class Katz:
    """Backoff probabilities by dictionaries, one history at a time."""

    def __init__(self, texts, order, cutoff=5):
        self.order, self.counts = order, collections.defaultdict(collections.Counter)
        for words in texts:
            line = ["<start>", *words, "<end>"]
            for i in range(1, len(line)):
                for k in range(min(order, i + 1)):
                    self.counts[tuple(line[i - k: i])][line[i]] += 1
        self.cut = {}
        for k in range(1, order + 1):
            of = collections.Counter(n for h, x in self.counts.items() if len(h) == k - 1 for n in x.values())
            over = (cutoff + 1) * of[cutoff + 1] / of[1] if of[1] else 1
            for r in range(1, cutoff + 1):
                d = ((r + 1) * of[r + 1] / (r * of[r]) - over) / (1 - over) if of[r] and over != 1 else 0
                self.cut[k, r] = d if 0 < d < 1 else (r - 0.5) / r
        self.known = {}

    def after(self, h):
        """Seen words after a history, each with its probability; and the rest's weight."""
        if h not in self.known:
            x, k = self.counts[h], len(h) + 1
            total = sum(x.values())
            kept = {w: n * self.cut.get((k, n), 1.0) for w, n in x.items()}
            left = total - math.fsum(kept.values())
            if left <= 1e-12:
                total, left = total + 1, 1.0
            low = math.fsum(self.p(h[1:], w) for w in x) if h else 0.0
            self.known[h] = {w: n / total for w, n in kept.items()}, left / total / (1 - low)
        return self.known[h]

    def p(self, h, w):
        if h and h not in self.counts:
            return self.p(h[1:], w)
        seen, weight = self.after(h)
        return seen[w] if w in seen else weight * (self.p(h[1:], w) if h else 1.0)


def score_rows(rows, order, held):
    """Katz scores and add-one scores of ``rows (doc_id, text)``."""
    words = [[w.decode() for w in (t or "").encode().lower().split()] for _, t in rows]
    train = [w for (d, _), w in zip(rows, words) if not held(d)]
    model = Katz(train, order)
    single = collections.Counter(w for x in train for w in [*x, "<end>"])
    n, v = sum(single.values()), len(single)
    out = []
    for (d, _), x in zip(rows, words):
        line = ["<start>", *x, "<end>"]
        out.append((d, held(d), len(x) + 1, sum(w in single for w in line[1:]), n,
                    sum(math.log10((single[w] + 1) / (n + v + 1)) for w in line[1:]),
                    sum(math.log10(model.p(tuple(line[max(0, i - order + 1): i]), line[i]))
                        for i in range(1, len(line)))))
    return in_order(out)


def url_verdicts(pages, rules, longest=24):
    """Verdicts and log odds of ``pages (page_id, url, html)`` by plain Viterbi and naive Bayes."""
    import regex
    counts = collections.Counter()
    for _, _, markup in pages:
        text = re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", (markup or "").lower())
        counts.update(w for w in regex.findall(r"\p{L}+", text) if len(w) <= longest)
    total = sum(counts.values()) or 1

    def cost(word):
        n = counts.get(word)
        return math.log(total / n) if n else math.log(total + 1) + (len(word) - 1) * math.log(10)

    def cut(run):
        best = [(0.0, [])]
        for end in range(1, len(run) + 1):
            best.append(min(((best[s][0] + cost(run[s:end]), best[s][1] + [run[s:end]])
                             for s in range(max(0, end - longest), end)), key=lambda x: x[0]))
        return best[-1][1]

    parts, tokens = [], {}
    for page_id, url, _ in pages:
        _, found, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if found else ""
        path = re.match(r"[^?#]*", rest[len(host):])[0] if found else ""
        host = host.translate(_LOWER)
        parts.append((page_id, host, path))
        words = ["h:" + w for run in regex.findall(r"\p{L}+", host) for w in cut(run)]
        tokens[host, path] = words + ["p:" + ("0" if regex.fullmatch(r"\p{N}+", t) else t)
                                      for t in regex.findall(r"[\p{L}\p{N}]+", path.lower())]

    def rule(host, path):
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
                and path.startswith("/" + r.partition("/")[2])]
        return min(fits, key=lambda r: (-len(r), r)) if fits else None

    seen, pages_of = {True: collections.Counter(), False: collections.Counter()}, collections.Counter()
    for _, host, path in parts:
        if (r := rule(host, path)) is not None:
            seen[rules[r] == "block"].update(tokens[host, path])
            pages_of[rules[r] == "block"] += 1
    known = set(seen[True]) | set(seen[False])
    sums = {k: sum(c.values()) + len(known) + 1 for k, c in seen.items()}
    out = []
    for page_id, host, path in parts:
        odds = math.log((pages_of[True] + 1) / (pages_of[False] + 1)) + sum(
            math.log((seen[True][t] + 1) / sums[True]) - math.log((seen[False][t] + 1) / sums[False])
            for t in tokens[host, path] if t in known)
        r = rule(host, path)
        out.append((page_id, host, path, r, rules[r] if r else "block" if odds > 0 else "allow", round(odds, 6)))
    return in_order(out)
