"""Small tables with the cases that every operator has to handle, and brute-force versions of operators."""

from __future__ import annotations

import zlib

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=True):
    """Rows (doc_id, text) as documents, with extra columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    if extra:
        for name in ("kept", "key", "id", "w", "digest", "ids", "score", "component_id", "text_key", "copies", "label"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
TRICKY = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "one two"), (5, "ONE  two"), (6, "é ü 한글 \U0001f389 <|endoftext|> x"), (7, LONG), (8, LONG + " tail"), (None, "no id at all"), (9, "one two")]


def same_rows(ours, theirs):
    """Whether two Arrow tables have the same rows in any order."""
    import duckdb

    con = duckdb.connect()
    con.register("ours", ours)
    con.register("theirs", theirs)
    columns = ", ".join(f'"{c}"' for c in sorted(theirs.column_names))
    return ours.num_rows == theirs.num_rows and not any(
        con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() for a, b in (("ours", "theirs"), ("theirs", "ours"))
    )


def oracle(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow() if hasattr(table, "toArrow") else table)
    return con.sql(sql).to_arrow_table()


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def near_components(rows):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = {}
    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in index.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            index[s].append(i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
