"""The posts view carries every document whole."""

from postlens.sources.tables import posts_from_documents, table

SF = "/root/testdata/sf0.01"


def test_whole_texts(spark):
    docs = table(spark, SF, "documents").withColumnRenamed("doc_id", "tweet_id")
    both = docs.join(posts_from_documents(spark, SF).select("tweet_id", "content"), "tweet_id")
    assert both.count() == docs.count()
    assert both.where("instr(content, text) = 0").count() == 0
