"""Fixed schemas of the library's tables."""

from __future__ import annotations

PAGES = "page_id bigint, url string, html string"
RESULTS = (
    "query_id bigint, engine string, engine_pos int, page int, pos int, title string, url string, snippet string, "
    "displayed_link string, date string, sitelinks array<struct<title:string,link:string>>"
)
LINKS = "page_id bigint, src_url string, pos int, dst_url string, text string"
HOST_SCAN = "ip string, ports array<int>, hostnames array<string>, cpes array<string>, tags array<string>, vulns array<string>"
OUTCOMES = "ts timestamp, key string, ok boolean, source string, duration_ms double, code string, message string"
QUERIES = "query_id bigint, position int, q string, engines string, num int, page int, params map<string,string>"
EXTRAS = (
    "knowledgeGraph struct<title:string,type:string,description:string,imageUrl:string,attributes:map<string,string>>, "
    "answerBox struct<answer:string,title:string>, peopleAlsoAsk array<struct<question:string>>, relatedSearches array<struct<query:string>>"
)
