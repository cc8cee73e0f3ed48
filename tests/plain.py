"""Plain Python versions of the operators, for comparison on small inputs."""

import math
import re
import string
from collections import Counter


# The patterns below must equal those of the library.


def clean(text):
    text = text.lower()
    for pattern in (r"<.*?>", r"@\w+", r"'\d+", r"\d+", r"http\w+"):
        text = re.sub(pattern, "", text)
    for pattern, one in ((r"\s+", " "), (r"\.+", "."), (r",+", ",")):
        text = re.sub(pattern, one, text)
    return text.strip()


def bare(text):
    return "".join(c for c in text if c not in string.punctuation)


def nearest(values, q):
    return sorted(values)[math.floor((len(values) - 1) * q + 0.5)]


def kurtosis(values):
    n, mean = len(values), sum(values) / len(values)
    second = sum((v - mean) ** 2 for v in values) / n
    return sum((v - mean) ** 4 for v in values) / n / second**2 - 3 if second else None


def summary(name, values):
    return {
        f"{name}_max": max(values),
        f"{name}_mean": sum(values) / len(values),
        f"{name}_min": min(values),
        f"{name}_sum": sum(values),
        f"{name}_first": values[0],
        f"{name}_last": values[-1],
        f"{name}_kurtosis": kurtosis(values),
        f"{name}_q1": nearest(values, 0.25),
        f"{name}_q3": nearest(values, 0.75),
    }


def essay_features(text, words, separator):
    paragraphs = [clean(p) for p in text.split(separator)]
    lengths = [len(p) for p in paragraphs]
    out = {f"paragraph_ge_{i}_cnt": sum(n >= i for n in lengths) for i in (0, 50, 75, 100, 125, 150, 175, 200, 250, 300, 350, 400, 500, 600, 700)}
    out |= {f"paragraph_le_{i}_cnt": sum(n <= i for n in lengths) for i in (25, 49)}
    out |= summary("paragraph_len", lengths)
    out |= summary("paragraph_sentence_cnt", [len(p.split(".")) for p in paragraphs])
    out |= summary("paragraph_word_cnt", [len(p.split(" ")) for p in paragraphs])
    out |= summary("paragraph_error_num", [sum(w not in words for w in bare(p).split(" ") if w) for p in paragraphs])

    sentences = [s for s in clean(text).split(".") if len(s) >= 15]
    lengths = [len(s) for s in sentences]
    names = [f"sentence_ge_{i}_cnt" for i in (0, 15, 50, 100, 150, 200, 250, 300)]
    if sentences:
        out |= {f"sentence_ge_{i}_cnt": sum(n >= i for n in lengths) for i in (0, 15, 50, 100, 150, 200, 250, 300)}
        out |= {f"sentence_le_{i}_cnt": sum(n <= i for n in lengths) for i in (15, 50)}
        out |= summary("sentence_len", lengths)
        out |= summary("sentence_word_cnt", [len(s.split(" ")) for s in sentences])
    else:
        out |= dict.fromkeys(names)

    lengths = [len(w) for w in clean(text).split(" ") if w]
    if lengths:
        mean = sum(lengths) / len(lengths)
        out |= {f"word_{i}_cnt": sum(n >= i for n in lengths) for i in range(1, 16)}
        out |= {
            "word_len_max": max(lengths),
            "word_len_mean": mean,
            "word_len_std": math.sqrt(sum((n - mean) ** 2 for n in lengths) / (len(lengths) - 1)) if len(lengths) > 1 else None,
            "word_len_q1": nearest(lengths, 0.25),
            "word_len_q2": nearest(lengths, 0.5),
            "word_len_q3": nearest(lengths, 0.75),
        }
    return out


def runs(text, sizes):
    return Counter(text[i : i + n] for n in range(sizes[0], sizes[1] + 1) for i in range(len(text) - n + 1))


def vocabulary(texts, sizes, limits):
    """``{term: (index, df)}`` of a fit on ``texts``."""
    df = Counter(term for text in texts for term in runs(text, sizes))
    kept = sorted(t for t, n in df.items() if limits[0] * len(texts) <= n <= limits[1] * len(texts))
    return {term: (i, df[term]) for i, term in enumerate(kept)}


def tfidf(text, vocab, n, sizes):
    """``{index: value}`` of one text."""
    weights = {
        vocab[t][0]: (1 + math.log(tf)) * (math.log((1 + n) / (1 + vocab[t][1])) + 1)
        for t, tf in runs(text, sizes).items()
        if t in vocab
    }
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {i: w / norm for i, w in weights.items()}


def kappa(y, p):
    labels = sorted(set(y) | set(p))
    rank = {label: i for i, label in enumerate(labels)}
    n = len(y)
    observed = sum((rank[a] - rank[b]) ** 2 for a, b in zip(y, p))
    expected = sum((rank[a] - rank[b]) ** 2 for a in y for b in p) / n
    return 1 - observed / expected if expected else None


def weighted_f1(y, p):
    total = 0.0
    for label in set(y):
        hits = sum(a == b == label for a, b in zip(y, p))
        total += y.count(label) * 2 * hits / (y.count(label) + p.count(label))
    return total / len(y)


def gradient(y, p, centre=2.998, variance=1.092):
    p = [min(6, max(1, v)) for v in p]
    f = sum((a - b) ** 2 for a, b in zip(p, y)) / 2
    g = sum((a - centre) ** 2 + variance for a in p) / 2
    return [((a - b) / g - f * (a - centre) / g**2) * len(y) for a, b in zip(p, y)]
