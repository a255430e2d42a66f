import hashlib
import random
import re

from rolegraph.llm import chat as M
from rolegraph.llm import queries

SCHEMA = "conv_id long, turn int, role string, text string, heads int, formatted string"


def escape(t):
    t = t.replace("\\", "\\\\")
    for c in M.CONTROL:
        t = t.replace(c, c[0] + "\\" + c[1:])
    return t


def brute(rows):
    """conv_id to (turns, formatted, loss spans), built turn by turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, *_ in rows if c == conv))
        text, loss, last = "", [], None
        for *_, role, x in turns:
            if role != last:
                text += ("" if last is None else "</s>") + "<s>" + escape(role)
            text += "[INST]"
            if role == "assistant":
                loss.append((len(text), len(escape(x))))
            text += escape(x) + "[/INST]"
            last = role
        out[conv] = ([(role, x) for *_, role, x in turns], text + "</s>", loss)
    return out


def conversations():
    r = random.Random(2)
    bits = ["hello", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\<s>", "é日本😀", "\n", "[\\INST]", "<<s>>", ""]
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randrange(6))), 1, "clash"))
    rows += [(50, 0, None, None, 1, "clash"), (50, None, "assistant", "first", 1, None), (50, 1, "assistant", None, 1, None), (None, 0, "user", "no key", 1, None), (None, 1, "assistant", "x", 1, None)]
    rows += [(51, 3, "b</s>", "tie b", 1, None), (51, 3, "assistant", "tie z", 1, None), (51, 3, "assistant", "tie a", 1, None), (51, 3, "assistant", "tie a", 1, None)]
    rows += [(52, t, "assistant" if t % 3 else "user", "word " * (t % 50), 1, None) for t in range(900)]
    rows += [(53, 0, "user", "<s>" * 60_000, 1, None), (53, 1, "assistant", "long \\ " * 30_000, 1, None), (54, 0, "", "", 1, None)]
    return rows


def test_against_a_loop_and_back(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    made = M.format_chat(table)
    got = {r.conv_id: r for r in made.collect()}
    assert got.keys() == want.keys()
    for k, (_, text, loss) in want.items():
        assert got[k].formatted == text, k
        assert [(s.start, s.length) for s in got[k].loss] == loss, k
    for r in M.read_chat(made).collect():
        turns, text, _ = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.learned == "".join(x for role, x in turns if role == "assistant") and r.formatted_chars == len(text)


def test_the_query_uses_no_python(spark, tmp_path):
    spark.createDataFrame(conversations(), SCHEMA).where("conv_id is not null").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op10_chat(spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|ExistingRDD", plan)
    got = {r.conv_id: r for r in out.collect()}
    both = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(both) and got[-7].loss_sha256 == hashlib.sha256(both.encode()).hexdigest()


def test_an_empty_table(spark):
    made = M.format_chat(spark.createDataFrame([], SCHEMA))
    assert made.count() == 0 and M.read_chat(made).count() == 0


def test_running_sums(spark):
    from rolegraph.llm._spark import with_running

    r = random.Random(1)
    rows = [(i, [r.randrange(9) for _ in range(n)]) for i, n in enumerate([0, 1, 63, 64, 65, 128, 500])]
    got = with_running(spark.createDataFrame(rows, "i int, n array<int>"), "n", "before").collect()
    for x in got:
        assert x.before == [sum(x.n[:k]) for k in range(len(x.n))]
