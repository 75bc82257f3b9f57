"""Small documents with every odd case, and brute-force versions of the operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

EXTRA = "sid long, gram string, bucket string, score string, n_words string, tag string, component_id string, `rows` string, flush string, n_chars long"


def sentence(rng, n, words=("alpha", "beta", "gamma", "delta", "the", "of", "Und", "été", "ñu", "x.")):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "\n"]) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [sentence(rng, 120) for _ in range(6)]
    passage = sentence(rng, 60)
    out = list(base)
    out += [base[0], base[0], base[1].upper()]
    out += [base[2].replace("alpha", "omega", 2), base[2] + " tail words here", base[3][:200] + passage + base[3][200:]]
    out += [passage, "start " + passage + " end", None, "", " \n\t", "one", "one two three", "a" * 400, "ab " * 300]
    out += ["Thor " * 60, "é" * 120, "日本語 テキスト " * 20, sentence(rng, 6000)]
    return out


def frame(spark, rows):
    """rows: (doc_id, text, lang); columns whose names operators use themselves come along."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for part in EXTRA.split(", "):
        name, kind = part.replace("`", "").split()
        df = df.withColumn(name, F.lit(None).cast(kind) if kind == "string" else F.lit(7).cast(kind))
    return df.repartition(3)


def cases(seed=1):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts(seed))]
    return [*rows, rows[0], rows[4], (None, rows[5][1], "en")]


def words(text):
    low = {c: chr(c + 32) for c in range(65, 91)}
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, num, den):
    sets = [shingles(t, n) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and den * both >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, (d, _, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(group) if sets[i] else d))
    return out


def removed(rows, length=50):
    """n_bytes, n_removed, n_spans, kept digest of each row."""
    first = {}
    for d, t, _ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            first[b[i : i + length]] = min(first.get(b[i : i + length], d), d)
    out = []
    for d, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def media(rows):
    out = []
    for d, t, _ in rows:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        out.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    return out


def quality(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {i + k for ps in at.values() if len(ps) > 1 for i in ps for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def ratios(rows, trusted, least, bits=14):
    """Mean log-ratio of each (doc_id, text, lang), a trusted row's own 4-grams taken out of the target."""

    def grams(text):
        b = (text or "").encode()
        return [(int.from_bytes(b[i : i + 4], "little") * 0x9E3779B1 % 2**32) >> (32 - bits) for i in range(len(b) - 3)]

    raw, target = {}, {}
    for d, t, lang in rows:
        raw.setdefault(lang or "", Counter()).update(grams(t))
        if d in trusted:
            target.setdefault(lang or "", Counter()).update(grams(t))
    out = []
    for d, t, lang in rows:
        g, llr = grams(t), 0.0
        r, mine = raw[lang or ""], Counter(target.get(lang or "", {}))
        if mine.total() >= least and g:
            if d in trusted:
                mine.subtract(g)
            n, m = mine.total(), r.total()
            if n >= least:
                llr = sum(math.log((mine[x] + 1) / (n + 2**bits)) - math.log((r[x] + 1) / (m + 2**bits)) for x in g) / len(g)
        out.append(llr)
    return out


def quotes(rows):
    """Quotation links of (conv_id, turn, role, text) by looking at every earlier message: one tuple for each."""

    def flat(text):
        return re.sub(r"\s+", " ", text.lower()).strip()

    def taken_apart(text):
        runs = []
        for line in (text or "").replace("\r\n", "\n").split("\n"):
            mark = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            level, said = (mark[1].count(">"), line[mark.end() :]) if mark else (0, line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(said)
            else:
                runs.append((level, [said]))
        body = "\n".join(x for level, xs in runs for x in xs if level == 0).strip(" \t\r\n")
        return body, [(level, "\n".join(xs)) for level, xs in runs if level]

    def units(text):
        return [[flat(x) for x in re.split(cut, text) if flat(x)] for cut in (r"\n[ \t]*\n", r"\n")]

    def common(xs, ys):
        table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    out = []
    for conv in sorted({c for c, *_ in rows}):
        mine = sorted((t, role, text) for c, t, role, text in rows if c == conv)
        parsed = [(t, role, *taken_apart(text)) for t, role, text in mine]
        parent, linked = {}, {}
        for t, _, _, passages in parsed:
            earlier = [(u, body) for u, _, body, _ in parsed if u < t]
            answers = None
            for level, quoted in passages:
                if not flat(quoted):
                    continue
                whole = [u for u, body in earlier if flat(quoted) in {flat(x) for x in [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]}]
                found = max(whole, default=None)
                if found is None:
                    shares = [(common(q, b) / len(q), u) for u, body in earlier for q, b in zip(units(quoted), units(body)) if len(q) > 1 and 2 * common(q, b) > len(q)]
                    found = max(shares)[1] if shares else None
                if found is not None:
                    linked[t] = linked.get(t, 0) + 1
                    if level == 1 and answers is None:
                        answers = found
            parent[t] = answers if answers is not None else max((u for u, _ in earlier), default=None)
        first, thread = {}, {}
        for t in sorted(parent):
            first.setdefault(parent[t], t)
            thread[t] = thread[parent[t]] if parent[t] is not None and first[parent[t]] == t else t
        place = {t: i for i, t in enumerate(sorted(parent, key=lambda t: (thread[t], t)))}
        out += [(conv, t, len(passages), linked.get(t, 0), parent[t], thread[t], place[t], body) for t, _, body, passages in parsed]
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
