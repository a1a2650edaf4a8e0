"""Plain Python versions of the operators, straight from their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\t-\r]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def shingles(text, n):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(docs, n, percent):
    """{key: smallest id reachable} for docs {key: (id, text)}."""
    sets = {k: shingles(t, n) for k, (_, t) in docs.items()}
    up = {k: k for k in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        shared = Counter(o for g in s for o in holders[g])
        for o, i in shared.items():
            if 100 * i >= percent * (len(s) + len(sets[o]) - i):
                a, b = root(k), root(o)
                if a != b:
                    up[a] = b
        for g in s:
            holders[g].append(k)
    least = {}
    for k, (i, _) in docs.items():
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return {k: (least.get(root(k)) if sets[k] else docs[k][0]) for k in docs}, sets


def repeated_words(docs, window):
    """{key: flags of the words that go} for docs {key: (id, text)}."""
    words = {k: SPACED.findall(t or "") for k, (_, t) in docs.items()}
    least = {}
    for k, (i, _) in docs.items():
        if i is not None:
            for j in range(len(words[k]) - window + 1):
                g = tuple(words[k][j : j + window])
                least[g] = min(i, least.get(g, i))
    out = {}
    for k, (i, _) in docs.items():
        gone = [False] * len(words[k])
        if i is not None:
            for j in range(len(gone) - window + 1):
                if least[tuple(words[k][j : j + window])] < i:
                    gone[j : j + window] = [True] * window
        out[k] = gone
    return words, out


def repeated_bytes(docs, length):
    """{id: flags of the bytes that go} for docs {id: text} with distinct ids."""
    seen, out = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if b[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(b[j : j + length])
        out[i] = (b, gone)
    return out


def contamination(text, items):
    """(n_words, n_hit, item ids, contaminated)."""
    w = ALNUM.findall((text or "").translate(LOW))
    hit, ids = set(), set()
    for item, t in items:
        v = ALNUM.findall((t or "").translate(LOW))
        for i in range(max(1, len(v) - 12)) if v else []:
            g = v[i : i + 13]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    ids.add(item)
    return len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w)


def base_scores(docs):
    """{key: (held_out, n_tokens, n_known, N, base score)} for docs {key: (id, text)}."""
    tokens = {k: [*SPACED.findall((t or "").translate(LOW)), None] for k, (_, t) in docs.items()}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in docs.items()}
    c = Counter(x for k in docs if not held[k] for x in tokens[k])
    n, v = sum(c.values()), len(c)
    return {k: (held[k], len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for k, t in tokens.items()}


M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def languages(pages, labelled, buckets=1 << 16, evidence=30.0, smoothing=5.0):
    """[(language, probability)] for pages (host, declared, text) given labelled (language, text)."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def trigrams(text):
        b = (text or "").encode().translate(low)
        return [mix(int.from_bytes(b[i : i + 3], "little")) & (buckets - 1) for i in range(len(b) - 2)]

    counts = defaultdict(Counter)
    for lang, text in labelled:
        if lang is not None and text is not None:
            counts[lang].update(trigrams(text))
    langs = sorted(x for x in counts if counts[x])
    size = {x: sum(counts[x].values()) + 0.5 * buckets for x in langs}
    soft = []
    for _, _, text in pages:
        g = trigrams(text)
        logs = [sum(math.log((counts[x][t] + 0.5) / size[x]) for t in g) * min(len(g), evidence) / max(len(g), 1) for x in langs]
        w = [math.exp(v - max(logs)) for v in logs]
        soft.append([v / sum(w) for v in w])
    k, total = len(langs), [sum(s[j] for s in soft) for j in range(len(langs))]
    sums = defaultdict(lambda: [0.0] * k)
    keys = [{"declared": d, "suffix": h.split(".")[-1], "domain": ".".join(h.split(".")[-2:]), "host": h} for h, d, _ in pages]
    for name, s in zip(keys, soft, strict=True):
        for key in name.items():
            sums[key] = [a + b for a, b in zip(sums[key], s, strict=True)]
    out = []
    for name, s in zip(keys, soft, strict=True):
        odds = []
        for j in range(k):
            overall = (max(0.0, total[j] - s[j]) + 1) / (max(sum(total) - 1, 0.0) + k)

            def share(kind, prior, j=j, s=s, name=name):
                held = sums[kind, name[kind]]
                return (max(0.0, held[j] - s[j]) + smoothing * prior) / (max(0.0, sum(held) - 1) + smoothing)

            odds.append(math.log(max(s[j], 1e-300)) + math.log(share("declared", overall) / overall) + math.log(share("suffix", overall) / overall) + math.log(share("host", share("domain", overall))))
        out.append((langs[odds.index(max(odds))], 1 / sum(math.exp(o - max(odds)) for o in odds)))
    return out


def posterior(ballots, prior=0.85, alarms=0.005, rounds=200):
    """Probability of being good for each ballot (votes 0 bad, 1 none, 2 good), by EM over all of them."""
    kinds = Counter(map(tuple, ballots))
    m = len(ballots[0])
    first = ([0.002, 0.4, 0.598], [0.2, 0.4, 0.4])
    good, bad = [list(first[0]) for _ in range(m)], [list(first[1]) for _ in range(m)]

    def odds(b):
        return math.log(prior / (1 - prior)) + sum(math.log(good[r][v] / bad[r][v]) for r, v in enumerate(b) if v != 1)

    for _ in range(rounds):
        p = {b: 1 / (1 + math.exp(-odds(b))) for b in kinds}
        ng, nb = sum(n * p[b] for b, n in kinds.items()), sum(n * (1 - p[b]) for b, n in kinds.items())
        new = []
        for r in range(m):
            g = [(sum(n * p[b] for b, n in kinds.items() if b[r] == v) + 10 * first[0][v]) / (ng + 10) for v in range(3)]
            h = [(sum(n * (1 - p[b]) for b, n in kinds.items() if b[r] == v) + 10 * first[1][v]) / (nb + 10) for v in range(3)]
            a = min(g[0], alarms)
            g = [a, g[1] * (1 - a) / (1 - g[0]), g[2] * (1 - a) / (1 - g[0])]
            new.append((g, h))
        good, bad = [g for g, _ in new], [h for _, h in new]
    return {b: 1 / (1 + math.exp(-odds(b))) for b in kinds}


def model_scores(docs, steps, grid):
    """{key: score} by quantised counts of words and pairs: steps[q - 1] is the least count of level q."""
    tokens = {k: [*SPACED.findall((t or "").translate(LOW)), None] for k, (_, t) in docs.items()}
    train = [k for k, (i, _) in docs.items() if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(), Counter()
    for k in train:
        one.update(tokens[k])
        two.update(zip([None, *tokens[k]], tokens[k], strict=False))
    n, v = sum(one.values()), len(one)
    level = lambda c: sum(s <= c for s in steps)
    count = lambda q: 0.0 if not q else (steps[q - 1] + steps[q] - 1) / 2

    def parts(a, b, out):
        before = level(one[a])
        context, single = max(count(before) - out, 0), max(count(level(one[b])) - out, 0)
        pair = min(max(count(level(two[a, b])) - out, 0), context, single)
        return before, pair / context if context > 0 else 0.0, (single + 0.5) / (n + 0.5 * (v + 1))

    gains = defaultdict(lambda: [0.0] * len(grid))
    for k in train:
        for a, b in zip([None, *tokens[k]], tokens[k], strict=False):
            q, pair, single = parts(a, b, 1)
            for g, w in enumerate(grid):
                gains[q][g] += math.log10(w * pair + (1 - w) * single)
    weight = {q: grid[max(range(len(grid)), key=lambda g, q=q: gains[q][g])] for q in gains}
    out = {}
    for k, t in tokens.items():
        told = [parts(a, b, 0) for a, b in zip([None, *t], t, strict=False)]
        out[k] = sum(math.log10(weight.get(q, 0.0) * pair + (1 - weight.get(q, 0.0)) * single) for q, pair, single in told)
    return out


def alignments(docs, byte_bpe, piece_model):
    """{row: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)} from whole texts, by the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=piece_model)
    a.encode_special_tokens = True
    symbols = {x: ord(x) for x in map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])}
    symbols |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if chr(c) not in symbols)}
    assert decoders.ByteLevel().decode([chr(256 + 32)]) == " "
    a_bytes = lambda i: bytes(symbols[x] for x in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, held = {}, Counter()
    for row, (_, text) in docs.items():
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or any(b"".join(map(f, z)) != (" " + text).encode() for f, z in ((a_bytes, x), (b_bytes, y))):
            found[row] = ([], [], [], [])
            continue
        spans = []
        for f, z in ((a_bytes, x), (b_bytes, y)):
            at, own = 0, []
            for i in z:
                own.append((at, at + len(f(i)), i))
                at += len(f(i))
            spans.append(own)
        links, j = [], 0
        for lo, hi, i in spans[0]:
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < hi:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({hi for _, hi, _ in spans[0]} & {hi for _, hi, _ in spans[1]})
        said = ["|".join(",".join(str(i) for lo, hi, i in own if prior <= lo < cut) for own in spans) for prior, cut in zip([0, *cuts[:-1]], cuts, strict=True)]
        found[row] = (x, y, said, links)
        held.update(set(links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return {
        row: (len(x), len(y), len(said), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha(";".join(said)) if said else "")
        for row, (x, y, said, links) in found.items()
    }


def resampled(docs, target, percent, most_run, buckets, least_words, seed):
    """[(doc_id, n_words, n_features, weight, score, rank)] of (doc_id, text) rows; rows that tie in id and score in any order."""

    def features(text):
        w = ALNUM.findall((text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most_run + 1) for i in range(len(w) - n + 1)]

    held = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, n, f in held:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    rest = Counter(rows) - Counter(drawn)
    return [(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in rest.elements()]
