"""Small tables with what real ones hold: nulls, blanks, copies, near copies, passages, repeated lines and rows."""

import random

NASTY = [None, "", " \t\n\x0b\x0c\r ", "a", "A b", "a B\nc", "É ñ ß 漢字 😀 <|endoftext|>", "\n\n\n", "x" * 5000, "no break   em", "word " * 400, "tab\tsep\x0bvt\x0cff\rcr"]


def rows(seed=1, n=120, ids=True):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeghiklmnorst") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["Ünï", "ÀB"]
    text = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(k))
    line = "This line of forty characters or more is Found in many documents"
    passage = text(70)
    out = list(NASTY)
    for _ in range(n):
        t = text(r.choice([3, 10, 30, 80, 200]))
        if r.random() < 0.3:
            t = t + "\n" + r.choice(["  ", ""]) + (line if r.random() < 0.5 else line.upper()) + "\n" + text(4)
        if r.random() < 0.2:
            t = t + " " + passage + " " + text(9)
        out.append(t)
    for _ in range(n // 3):
        t = r.choice([x for x in out if x])
        w = t.split(" ")
        for _ in range(r.choice([0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(r.choice([" ".join(w), t, t.replace(" ", "  "), t.upper()]))
    r.shuffle(out)
    made = [(k * 3 + 1, t) for k, t in enumerate(out)]
    return made + ([(None, "a lone row without an id"), (None, out[5]), made[7], made[20]] if not ids else [])


def table(spark, made, partitions=5, **extra):
    data = [(i, t, ["en", "de", None, "xx"][k % 4], [None, "b", "a", "c", "c"][k % 5], len(t or ""), "clash", 7) for k, (i, t) in enumerate(made)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, row string, h1 int").repartition(partitions)
