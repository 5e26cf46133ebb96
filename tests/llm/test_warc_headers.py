"""Headers of a revisit replace those of the response, whatever the case of their names."""

from folioflow.llm import warc


def test_header_names_in_any_case(spark):
    schema = "record_id long, type string, url string, ts long, etag string, digest string, headers map<string,string>"
    sent = {"Date": "old", "ETag": "e", "content-type": "text/html", "VARY": "x"}
    own = {"date": "new", "Etag": "e", "Content-Length": "0", "Vary": "y"}
    rows = [(1, "response", "http://a/", 1, "e", "d", sent), (2, "revisit", "http://a/", 5, "e", "d", own), (3, "revisit", "http://a/", 6, None, None, None)]
    got = {r.record_id: r.headers for r in warc.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: {"date": "new", "Etag": "e", "content-type": "text/html", "Vary": "y"}, 3: sent}
