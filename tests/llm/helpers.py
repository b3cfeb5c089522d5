"""Small tables and slow, plain versions of the operators."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def documents(spark, texts, langs=None):
    """texts: {id: text} or (id, text) pairs."""
    pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
    return spark.createDataFrame([(i, t, langs[k] if langs else "en", "src", None if t is None else len(t)) for k, (i, t) in enumerate(pairs)], DOCS)


def saved(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, size):
    w = words(ascii_lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def slow_components(pairs, size, percent):
    """{id: (set size, smallest reachable id, links)}"""
    sets = {i: shingle_set(t, size) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}
