from codekiln.llm import near_duplicates


def test_long_texts_agree_by_chance_in_one_of_256(spark):
    texts = [" ".join(f"{name}{k}" for k in range(1500)) for name in "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    a, b = (r["signature"] for r in near_duplicates.signatures(rows, "k", "t", near_duplicates.NearDuplicateParams()).orderBy("id").collect())
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 10
