import random
from collections import Counter

from rankloom.llm import pairdefects, sentences

ENGLISH = [
    "Dr. Rinith Norjorith said the Beane watchdog had fined Loris Inc. 865.61 million yuan.",
    "By 9.30 a.m. in Renock, Loris Corp. stood at 775.45, down 13.7 percent, e.g. on No. 4 paper.",
    'In Selia, Mr. Wilen asked: "Who pays for freight? Nobody has told us."',
    '"We see no panic. The order book is full," said Ms. Halis of Reneth Industries Inc.',
    "Under terms signed on Feb. 11, Fenbais Bank buys 28.0 percent of Garis Bank, under Art. 6 of the code.",
    "Shares of Baum Holdings fell at 5 p.m.",
]
NAMES = ["Rinith", "Wilen", "Halis", "Talor", "Zelum", "Borith", "Quenia", "Lorane"]


def model(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.sample(ENGLISH, 3)).replace("Dr. Rinith", "Dr. " + rng.choice(NAMES)).replace("Mr. Wilen", "Mr. " + rng.choice(NAMES)).replace("Ms. Halis", "Ms. " + rng.choice(NAMES)) for _ in range(150)]
    low = ["the shares of a bank under review by an analyst in a town"] * 5
    return sentences.learn(spark.createDataFrame([(t,) for t in texts + low], "text string"))


def cut(text, m=sentences.EMPTY):
    return [text[a:b] for a, b in sentences.spans(text, m)]


def test_learned_periods(spark):
    m = model(spark)["en"]
    assert {"dr", "mr", "feb", "art", "e.g", "a.m"} <= m.abbreviations and "no" in m.leads
    rng = random.Random(1)
    for _ in range(60):
        want = rng.sample(ENGLISH, 4)
        assert cut(" ".join(want), m) == want
        assert cut("\n".join(want), m) == want


def test_rules_without_a_model():
    assert cut("“市场并不恐慌。订单已满。”某行长称。另一句！") == ["“市场并不恐慌。订单已满。”某行长称。", "另一句！"]
    assert cut("某人问：“谁承担成本？还没有人告诉我们。”2月利率维持在3.5%。") == ["某人问：“谁承担成本？还没有人告诉我们。”", "2月利率维持在3.5%。"]
    assert cut("氏は「混乱はない。4月まで待つ。」と述べた。次の文。") == ["氏は「混乱はない。4月まで待つ。」と述べた。", "次の文。"]
    assert cut("前提是不再拖累……如果有那一天。完") == ["前提是不再拖累……如果有那一天。", "完"]
    assert cut("作价5亿克朗. 总体来看，下跌3.5%. 即") == ["作价5亿克朗.", "总体来看，下跌3.5%.", "即"]
    assert cut("Rates rose.Shares fell. It ends") == ["Rates rose.", "Shares fell.", "It ends"]
    assert cut("« Personne ne panique. Nous attendrons », a déclaré X. Le titre monte.") == ["« Personne ne panique. Nous attendrons », a déclaré X.", "Le titre monte."]
    assert cut("„Wir bleiben. Das Buch ist voll“, sagte Y. Die Aktie fiel.") == ["„Wir bleiben. Das Buch ist voll“, sagte Y.", "Die Aktie fiel."]
    assert cut("यह है। वह है।") == ["यह है।", "वह है।"]
    assert cut("Headline; one: two, three") == ["Headline; one: two, three"]
    assert cut("") == [] and cut(None) == [] and cut(" …\n—") == []


def test_positions_are_those_of_the_original():
    text = "　Ra​tes ﬁnally rose. \nSh﻿ares fell "
    assert sentences.spans(text) == [(1, 20), (22, 34)]
    long = "Rates rose. " * 30_000
    assert len(sentences.spans(long)) == 30_000


def test_sentence_table(spark):
    v = "array<struct<id:string,feature_target:string,translation:string>>"
    rows = [(1, 1, "Rates rose. Shares fell.", [(" a", None, "一。二。"), ("B", None, None)]), (1, 1, "Rates rose. Shares fell.", [(" a", None, "一。二。"), ("B", None, None)]), (2, 1, None, None)]
    df = spark.createDataFrame(rows, f"sample_id bigint, generation_round bigint, source_text string, variants {v}")
    got = sorted(map(tuple, sentences.sentences(sentences.parts(df), ["sample_id", "generation_round", "text_part"], "text").collect()))
    assert got == [(1, 1, "A", 0, 2), (1, 1, "A", 2, 4), (1, 1, "source_text", 0, 11), (1, 1, "source_text", 12, 24)]
    assert sentences.sentences(sentences.parts(df.limit(0)), ["sample_id"], "text").count() == 0


def good_rows(rng, n):
    names, cities, goods = ["霍赫工业公司", "蒙赫兰能源公司", "诺扎证券"], ["托洛", "希梅索", "瑞兰"], ["锂盐", "机床", "收割机"]
    for k in range(n):
        a, b, c, g = rng.choice(names), rng.choice(cities), rng.randrange(100, 999), rng.choice(goods)
        src = f"In March, rental income at Company {k} in Town {k} grew by {c / 10} percent to {c}.5 million crowns. A plant for goods near Place {k} is to hire {c + 7} people, by October 2031."
        forms = [
            f"3月，{a}在{b}的租金收入同比增长{c / 10}%，达到{c}50万克朗。", f"{a}公布{b}3月租金收入为{c}50万克朗，同比增长{c / 10}%。", f"{b}的{a}录得3月租金收入{c}50万克朗，较上年同期增加{c / 10}%。",
        ]
        tails = [f"{g}工厂将在附近新建，招聘{c + 7}人，预计2031年10月完工。", f"附近将建成一座招聘{c + 7}人的{g}工厂，预计2031年10月完工。"]
        yield src, [forms[i % 3] + tails[i % 2] for i in range(6)]


def test_injected_defects_are_found():
    rng = random.Random(7)
    refusals = ["抱歉，我无法翻译这段文字。", "作为翻译模型，我不能提供该版本。", "I'm sorry, but I can't assist with that request.", "由于内容限制，此段不予翻译。感谢理解。"]
    empties = [None, "", " ", "N/A", "（空）", "…", "***"]
    foreign = ["Les revenus de la société ont progressé en mars, et une usine ouvrira bientôt près de la ville voisine.", "売上は3月に前年同月比で増加し、新しい工場が開かれる予定である。"]
    patterns = {d: Counter() for d in pairdefects.DEFECTS}
    seen, truth = [], []
    for src, texts in good_rows(rng, 500):
        kinds = [None] * 6
        if rng.random() < 0.5:
            i = rng.randrange(6)
            kinds[i] = rng.choice(pairdefects.DEFECTS)
            texts[i] = {
                "empty": lambda: rng.choice(empties), "refusal": lambda: rng.choice(refusals), "copied_source": lambda: rng.choice(["译文：", ""]) + rng.choice([src, src.upper()]),
                "other_language": lambda: rng.choice(foreign), "truncated": lambda: texts[i][: int(len(texts[i]) * rng.uniform(0.3, 0.8))],
            }[kinds[i]]()
        elif rng.random() < 0.2:
            texts[rng.randrange(6)] = texts[0].rstrip("。")  # a missing final mark is no defect
        for f, kind in zip(pairdefects.votes(src, texts), kinds):
            p = {d: "".join("?01"[f[k] + 1] for k in pairdefects.FUNCTIONS[d]) for d in pairdefects.DEFECTS}
            for d in pairdefects.DEFECTS:
                patterns[d][p[d]] += 1
            seen.append(p)
            truth.append(kind)
    post = {d: pairdefects.fit(dict(patterns[d])) for d in pairdefects.DEFECTS}
    cuts = {d: pairdefects.cutoff(patterns[d], post[d]) for d in pairdefects.DEFECTS}
    got = [next((d for d in pairdefects.DEFECTS if post[d][p[d]] >= cuts[d]), None) for p in seen]
    for d in pairdefects.DEFECTS:
        hits = sum(g == t == d for g, t in zip(got, truth))
        assert hits >= 0.9 * sum(t == d for t in truth), d
        assert hits >= 0.95 * sum(g == d for g in got), d


def test_refusals_of_unseen_wording():
    rng = random.Random(11)
    known = ["抱歉，我无法翻译这段文字。", "由于内容限制，此段不予翻译。感谢理解。", "I'm sorry, but I can't assist with that request."]
    unseen = ["这件事我做不了，换个人吧。", "Nope, not doing this one.", "I'd rather not touch that paragraph.", "此内容超出本人职责。"]
    foreign = ["Les revenus de la société ont progressé de 12,5 pour cent en mars, et une usine ouvrira bientôt près de la ville voisine.", "The harbour was calm while 700 gulls circled over wooden boats that nobody had painted since the autumn of the great storm."]
    counts, seen = Counter(), []
    for n, (src, texts) in enumerate(good_rows(rng, 400)):
        kind = None
        if n % 4 == 0:
            kind, pool = [("known", known), ("unseen", unseen), ("foreign", foreign)][n // 4 % 3]
            at = rng.randrange(6)
            texts[at] = pool[n // 12 % len(pool)]
        for i, f in enumerate(pairdefects.votes(src, texts)):
            p = pairdefects.pattern(f, "refusal")
            counts[p] += 1
            seen.append((p, kind if kind and i == at else None))
    post = pairdefects.fit(dict(counts))
    least = pairdefects.cutoff(counts, post)
    for kind, share in (("known", 0.9), ("unseen", 0.9)):
        hits = [post[p] >= least for p, k in seen if k == kind]
        assert sum(hits) >= share * len(hits), kind
    assert sum(post[p] >= least for p, k in seen if k in (None, "foreign")) <= 0.01 * len(seen)


def test_cutoffs_hold_on_the_other_half():
    clear = {"111": 40, "000": 900, "100": 8}
    judge = pairdefects.held_out([clear, clear | {"110": 1}])
    assert judge["111"] > 0.99 and judge["000"] < 0.01 and 0 < judge["110"] < 1
    flags, doubt = {"11": 0.99, "10": 0.92, "00": 0.0}, {"11": 0.99, "10": 0.1, "00": 0.0}
    counts = {"11": 500, "10": 5, "00": 900}
    assert pairdefects.cutoff(counts, flags) == 0.92
    assert pairdefects.cutoff(counts | {"10": 50}, flags, doubt) == 0.99
    assert pairdefects.held_out([{}, {}]) == {} and pairdefects.cutoff({}, {}, {}) == pairdefects.FLOOR


def test_defect_table(spark):
    v = "array<struct<id:string,feature_target:string,translation:string>>"
    src, texts = next(good_rows(random.Random(1), 1))
    rows = [(1, 1, src, [(x, "t", t) for x, t in zip("ABCDEF", texts)]), (2, 1, None, [("A", None, None), ("B", None, "N/A"), (None, None, "x")]), (3, 1, src, []), (4, 1, src, None), (2, 1, None, [("A", None, None), ("B", None, "N/A"), (None, None, "x")])]
    df = spark.createDataFrame(rows, f"sample_id bigint, generation_round bigint, source_text string, variants {v}")
    got = sorted(map(tuple, pairdefects.defects(df).collect()))
    assert got == [(2, 1, "A", "empty"), (2, 1, "B", "empty")]
    assert pairdefects.defects(df.limit(0)).count() == 0


def test_label_model_separates_classes():
    rng = random.Random(3)
    counts, truth = Counter(), {}
    for _ in range(20_000):
        bad = rng.random() < 0.04
        p = "".join("?" if rng.random() < 0.1 else str(int(rng.random() < (0.85 if bad else 0.02))) for _ in range(5))
        counts[p] += 1
        truth.setdefault(p, []).append(bad)
    post = pairdefects.fit(dict(counts))
    right = sum(sum(x == (post[p] > 0.5) for x in xs) for p, xs in truth.items())
    assert right / 20_000 > 0.995 and pairdefects.fit({}) == {}


def test_numbers_in_both_scales():
    assert pairdefects.numbers("476.41 million and 1,234 and 3.50 percent") == {"476410000", "1234", "3.5"}
    assert pairdefects.numbers("47641万，618.74亿，1234，3.5%") == {"476410000", "61874000000", "1234", "3.5"}


def test_learned_entries_are_not_capped(spark, monkeypatch):
    monkeypatch.setattr(sentences, "MODEL_ENTRIES", 1, raising=False)
    words = ["abt", "qty", "vol"]
    texts = [(f"The clerk wrote the {w}. of goods down in the large book number {k} today. Nobody knew about the old list.",) for w in words for k in range(30)]
    models = sentences.learn(spark.createDataFrame(texts, "text string"))
    assert set(words) <= set().union(*(m.abbreviations for m in models.values()))
