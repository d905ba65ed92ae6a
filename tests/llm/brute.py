"""Plain versions of the operators, for small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = str.maketrans(UPPER, UPPER.lower())
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWERED))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))


def corpus(n=120, seed=3):
    """Rows of documents with copies, shared lines, odd texts, nulls and ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))
    shared = [line() + " shared by many documents" for _ in range(4)]
    texts = []
    for i in range(n):
        lines = [line().capitalize() for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "  "]) + rng.choice(shared).upper() + rng.choice(["", "\t"]))
        texts.append("\n".join(lines))
    for i in range(n // 4):  # near copies, from hardly to much changed
        base = rng.choice(texts[:n]).split(" ")
        for _ in range(rng.randint(1, 4)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    texts += [texts[0]] * 5 + ["", "", " \n\t", "one", "one two", "ONE two", "x" * 3000, (shared[0] + "\n") * 3, "é" * 19, "é" * 20, "é" * 20, "é" * 20, None, None, " ".join(vocabulary) * 20]
    rows = [(i * 3 % 1009, t, "en", rng.choice(["a", "b", "c", "B", "é", None, "a", "a"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def shingles(text, n=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k), root(k) == k) for k in ids}


def kept_lines(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWERED)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    out = {}
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and doc != max(holders[key(x)]))]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    out = {}
    for doc, text, *_ in rows:
        w, hit, found = alnum(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def targets(rows):
    size = defaultdict(int)
    for _, text, _, source, _ in rows:
        size[source] += len(words(text))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, got = float(sum(size.values())), set(order), dict.fromkeys(order, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 3 * size[s]}
        if not full:
            got |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            got[s] = 3.0 * size[s]
        left -= sum(got[s] for s in full)
        open_ -= full
    return dict(size), got


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def luhn(digits):
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def personal(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(x.lstrip("0")) < 4 and int("0" + x.lstrip("0")) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def _free(text):
    """(word, start, end, finds) of the words outside all finds, and the finds."""
    found = personal(text)
    every = [(m.group(), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))]
    return every, [w for w in every if all(w[2] <= a or b <= w[1] for _, a, b in found)], found


def revealing(rows, entity_of, reach, disclosure, support, spread):
    both, texts, held, n, total = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(int), 0
    for _, text in rows:
        every, free, found = _free(text)
        total += len(every)
        for w, _, _ in every:
            n[w] += 1
        near = set()
        for kind, a, b in found:
            before, after = [w for w in every if w[2] <= a][-reach:], [w for w in every if w[1] >= b][:reach]
            near |= {(w, entity_of(kind, text[a:b])) for w in before + after if w in free}
        for w, e in near:
            both[w[0], e] += 1
            texts[w[0], e].add(text)
            held[e] += 1
    content = {e: -math.log2(c / total) for e, c in held.items()}
    return {w for (w, e), c in both.items() if c >= support and len(texts[w, e]) >= spread and math.log2(c / n[w]) + content[e] >= disclosure * content[e]}


def stands(text, terms):
    return [(a, b) for w, a, b in _free(text)[1] if w in terms]


def secret(text):
    text, out = text or "", []
    name = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    out += [("assign", *m.span()) for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def ftrl(rows, bias, alpha, beta, l1, l2):
    """Weights of FTRL-proximal over (features, label), one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        over = abs(z[i]) - (0.0 if i == bias else l1)
        return -math.copysign(over, z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2) if over > 0 else 0.0

    for features, label in rows:
        w = {i: weight(i) for i in (*features, bias)}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in w:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    return {i: w for i in z if (w := weight(i))}


def edited(rows):
    order = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    out = {}
    for i, doc in enumerate(order):
        after, own = text[order[(i + 1) % len(order)]], text[doc]
        k = len(own) // 3
        out[doc] = (len(own), own[: len(own) - k] + after[:k], order[(i + 1) % len(order)])
    return out


def phrases(symbols, rounds):
    """One level of locally consistent parsing: the phrases, as tuples of (symbol, run length)."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    label = [x for x, _ in runs]
    for _ in range(rounds):
        new = []
        for i, own in enumerate(label):
            left = label[i - 1] if i else own ^ 1
            bit = 0
            while not (own ^ left) >> bit & 1:
                bit += 1
            new.append(2 * bit + (own >> bit & 1))
        label = new
    out = []
    for i, (x, n) in enumerate(runs):
        peak = i and label[i] > label[i - 1] and (i == len(runs) - 1 or label[i] >= label[i + 1])
        if not i or peak:
            out.append([])
        out[-1].append((x, n))
    return [tuple(x) for x in out]


def crc(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def base_scores(rows):
    count, ends = defaultdict(int), 0
    for doc, text, *_ in rows:
        if crc(doc, 7) != 2:
            ends += 1
            for w in words(text):
                count[w] += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    out = {}
    for doc, text, *_ in rows:
        tokens = [count.get(w, 0) for w in words(text)] + [ends]
        out[doc] = (crc(doc, 7) == 2, len(tokens), sum(c > 0 for c in tokens), n, sum(math.log10((c + 1) / (n + v + 1)) for c in tokens))
    return out


def spelled(vocabulary, code, mixer, model):
    """log10 probability of each word by a mixer that goes bit by bit, with counts in plain dictionaries."""
    counts = defaultdict(lambda: [0, 0])

    def steps(word):
        text = word + b" "
        for i, byte in enumerate(text):
            back = [text[i - k] if i >= k else None for k in (1, 2, 3)]
            contexts = [("place", min(i, 15)), ("one", *back[:1]), ("two", *back[:2]), ("three", *back)] + [("whole", text[:i] if i < model.WHOLE else None)]
            for depth in range(code.length[byte]):
                yield [(c, int(code.node[byte, depth])) for c in contexts], int(code.bit[byte, depth]), depth

    for word, times in vocabulary.items():
        for contexts, bit, _ in steps(word):
            for c in contexts:
                counts[c][bit] += times
    out = {}
    for word in vocabulary:
        total = 0.0
        for contexts, bit, depth in steps(word):
            pairs = [(0, 0) if c[0] == ("whole", None) else counts[c] for c in contexts]
            inputs = [math.log((b + model.SMOOTH) / (a + model.SMOOTH)) for a, b in pairs] + [1.0]
            gate = min(depth, 7) * 8 + min(7, math.ceil(math.log2(1 + sum(pairs[-1])) / 2))
            x = max(-15.0, min(15.0, sum(w * i for w, i in zip(mixer.weights[gate], inputs, strict=True))))
            place = max(0.0, min(model.LEVELS - 1.001, x / model.WIDTH + (model.LEVELS - 1) / 2))
            at, share = gate * model.LEVELS + int(place), place - int(place)
            p = (1 / (1 + math.exp(-x)) + mixer.refine[at] * (1 - share) + mixer.refine[at + 1] * share) / 2
            p = max(1e-6, min(1 - 1e-6, p))
            total += math.log10(p if bit else 1 - p)
        out[word] = total
    return out


def matches(texts):
    """(row, token, hit, gate, length) of each token at which a word is expected; an end is one more token of its row."""
    out, base = [], 0
    for row, text in enumerate(texts):
        w, last, run = [*words(text), None], {}, 0
        for t in range(1, len(w)):
            p = last.get(w[t - 1])
            if p is None:
                run = 0
            else:
                agree = t >= 2 and p >= 1 and w[p - 1] == w[t - 2]
                hit = w[p + 1] == w[t]
                out.append((row, base + t, hit, min(run, 3) << 1 | agree, min(run, 15)))
                run = run + 1 if hit else 0
            last[w[t - 1]] = t - 1
        base += len(w)
    return sorted(out)


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(LOWERED)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"
