"""The source audit against a plain count, with odd rows."""

import collections
import re

from parlance.llm import divergence


def plain(rows, at_least=3, ranks=200):
    """Rows of the audit of (lang, source, text), term by term and pair by pair."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, counts = collections.Counter(), collections.defaultdict(collections.Counter)
        for _, source, text in (r for r in rows if r[0] == lang):
            terms = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
            docs.update(set(terms))
            counts[source].update(terms)
        kept = [t for t in docs if docs[t] >= at_least]
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        share = lambda n, all_: 1 + 10**9 * (n + 1) // (all_ + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for a in counts:
            pairs = [(b, sum(f(share(counts[a][t], total[a]), share(counts[b][t], total[b])) for t in kept)) for b in counts if b != a]
            overall = {t: share(sum(c[t] for c in counts.values()), sum(total.values())) for t in kept}
            terms = [(t, f(share(counts[a][t], total[a]), overall[t])) for t in kept if counts[a][t] and share(counts[a][t], total[a]) > overall[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, a, part, item, value, rank))
    return sorted(out)


def found(df, **options):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, **options).collect())


def test_odd_rows(odd, empty):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert found(odd) == plain(rows)
    assert found(odd, at_least=1, ranks=2) == plain(rows, 1, 2)
    assert divergence.audit(empty).count() == 0


def test_more_ties_and_sources(spark, monkeypatch):
    words = ["Aa", "aA", "b", "é", "É", "zz", "日本", "c", "d", "e"]
    rows = [("en" if i % 4 else None, None if i % 7 == 0 else f"s{i * i % 5}", " ".join(words[(i * k + k * k) % 10] for k in range(i % 9)) + "1b") for i in range(90)]
    rows += [("en", "nothing", None), ("xx", "alone", "one two"), ("yy", "p", ""), ("yy", "q", "...")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    assert found(docs) == plain(rows)
    monkeypatch.setattr(divergence, "HELD_BYTES", 1)
    assert found(docs, ranks=3) == plain(rows, ranks=3)
