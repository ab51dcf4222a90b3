from formloom.llm.decontaminate import decontaminate

from .cases import frame


def test_short_items_leak_word_for_word(spark):
    items = [(1, "What is  2+2?"), (2, "cat"), (3, "What is 2+2?"), (4, " "), (5, None), (6, "nowhere"), (7, "日本")]
    data = [(10, "so: WHAT\nis 2+2? and more", "en"), (11, "concatenate, then a Cat. cat", "en"), (12, "concat cats", "en"), (13, None, "en"), (14, "é 日本 ", "xx")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for chars in (8_000_000, 10):
        got = decontaminate(frame(spark, data), table, block_chars=chars).collect()
        assert sorted(map(tuple, got)) == [(10, 1, 4, 16, 0, True), (10, 3, 4, 16, 0, True), (11, 2, 20, 23, 0, True), (14, 7, 2, 4, 0, True)]
