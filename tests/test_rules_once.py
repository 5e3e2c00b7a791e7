"""Work that was done several times or at every place of a text: Treebank rules, sentences of the judge, blocks of ROUGE-L."""

import os
import random

from pyspark.sql import functions as F

from evalspark.functions import treebank
from evalspark.operators.judging import unit_requests
from evalspark.operators.lcs import rouge_l

W = treebank.W
#: The rules that now begin with a rare character, as they were.
PLAIN = {
    treebank.SENTENCES[0]: (rf"(?<![{W}.])((?:(?i:{treebank._SHORT})|\p{{Lu}})\.) ", rf"$1{treebank.TIED}"),
    treebank.WORDS[0]: (r"([«“‘„]|`+)", " $1 "),
    treebank.WORDS[5]: (r"([^.\n])\.([\])}>\"'»”’ ]*)\n", "$1 . $2 \n"),
    treebank.WORDS[15]: (r"([^' ])('[sSmMdD]|') ", "$1 $2 "),
    treebank.WORDS[16]: (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    treebank.WORDS[17]: (treebank.WORDS[17][0].replace("(?=[cgldm])", ""), treebank.WORDS[17][1]),
    treebank.WORDS[18]: (treebank.WORDS[18][0].replace("(?=w)", ""), treebank.WORDS[18][1]),
}


def test_rules_do_what_their_plain_forms_do(spark):
    rnd = random.Random(3)
    parts = ["Mr.", "e.g.", "J.", "x", " ", " ", "  ", "\t", "\n", " ", "  ", "'", "''", "`", "``", "“", "«", ".", "..", ")", '"', "n't", "N'T",
             "'ll", "'VE", "'s", "'D", "cannot", "Gonna", "wanna", "d'ye", "é", "😀", "7", "St.", "u.s.", "A", "?"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, t string")

    def blanks(c, pattern):
        return F.regexp_replace(c, F.lit(pattern), F.lit(" "))

    cols = [(blanks(F.col("t"), treebank.BLANKS) != blanks(F.col("t"), treebank.BLANK)).cast("int").alias("blanks")]
    cols += [
        (F.regexp_replace("t", F.lit(p), F.lit(to)) != F.regexp_replace("t", F.lit(q), F.lit(by))).cast("int").alias(f"rule_{k}")
        for k, ((p, to), (q, by)) in enumerate(PLAIN.items())
    ]
    once = df.select(F.concat(F.lit("\n"), "t", F.lit(" \n")).alias("t")).select(*cols)
    assert once.groupBy().sum().first() == tuple([0] * len(cols))


def test_no_rule_begins_with_any_character():
    for pattern, _ in [(treebank.BLANKS, " "), *treebank.SENTENCES, *treebank.WORDS]:
        assert not pattern.startswith((r"([^' ])", "(?<!", r"([^.\n])")), pattern


def test_a_text_is_split_into_sentences_once(spark):
    cases = spark.createDataFrame([("e", "m", "p", "r", "a", "c")], "evaluation_id string, model string, prompt string, reference_answer string, response string, context string")
    plan = unit_requests(cases.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("messrs") == 3  # response, context, reference answer


def test_blocks_are_kept_by_place(spark):
    from evalspark.session import checkpoint_dir

    words = [f"w{i % 7}" for i in range(25)]
    df = spark.createDataFrame([("p", " ".join(words), " ".join(words[3:]))], "pair_id string, candidate string, reference string")
    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    got = rouge_l(df, block_tokens=10).first().rouge_l
    assert got == rouge_l(df).first().rouge_l
    kept = [x for x in os.listdir(base) if x not in before and x.startswith("lcs-") and x.endswith("-c")]
    assert [sorted(d for d in os.listdir(f"{base}/{x}") if d.startswith("a=")) for x in kept] == [["a=0", "a=1", "a=2"]]
