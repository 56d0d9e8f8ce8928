"""Analysis requests with the tokens they must give, as (name, request, settings, text, tokens)."""

from __future__ import annotations

BONE = "The 2 QUICK Brown-Foxes jumped over the lazy dog's bone."
FOX = "a quick fox jumps over the lazy dog"
DIGITS = ["٠ => 0", "١ => 1", "٢ => 2", "٣ => 3", "٤ => 4", "٥ => 5", "٦ => 6", "٧ => 7", "٨ => 8", "٩ => 9"]


def _custom(tokenizer: dict) -> dict:
    return {"analyzer": {"mine": {"tokenizer": "own"}}, "tokenizer": {"own": tokenizer}}


CASES: list[tuple[str, dict, dict, str, list[str]]] = [
    ("standard", {"analyzer": "standard"}, {}, BONE, "the 2 quick brown foxes jumped over the lazy dog's bone".split()),
    ("standard with stop words", {"analyzer": "mine"}, {"analyzer": {"mine": {"type": "standard", "stopwords": ["_english_"]}}}, BONE, "2 quick brown foxes jumped lazy dog's bone".split()),
    ("standard with filters", {"analyzer": "mine"}, {"analyzer": {"mine": {"type": "standard", "stopwords": ["_english_"], "token_filter": ["lowercase", "apostrophe", "len"]}}, "token_filter": {"len": {"type": "length", "min": 2, "max": 10}}}, BONE, "quick brown foxes jumped lazy dog bone".split()),
    ("simple", {"analyzer": "simple"}, {}, BONE, "the quick brown foxes jumped over the lazy dog s bone".split()),
    ("keyword", {"analyzer": "keyword"}, {}, BONE, [BONE]),
    ("regexp", {"analyzer": "regexp"}, {}, BONE, "the 2 quick brown foxes jumped over the lazy dog s bone".split()),
    ("pattern", {"analyzer": "mine"}, {"analyzer": {"mine": {"type": "pattern", "pattern": r"[^\W_]+", "lowercase": True}}}, "John_Smith@foo-bar.com", "john smith foo bar com".split()),
    ("stop", {"analyzer": "stop"}, {}, BONE, "quick brown foxes jumped lazy dog s bone".split()),
    ("stop with words", {"analyzer": "mine"}, {"analyzer": {"mine": {"type": "stop", "stopwords": ["the", "over"]}}}, BONE, "quick brown foxes jumped lazy dog s bone".split()),
    ("whitespace", {"analyzer": "whitespace"}, {}, BONE, BONE.split()),
    ("web", {"analyzer": "web"}, {}, "Hello info@example.com, i come from https://docs.example.dev/", "hello info@example.com come https://docs.example.dev/".split()),
    ("tokenizer standard", {"tokenizer": "standard"}, {}, BONE, "The 2 QUICK Brown Foxes jumped over the lazy dog's bone".split()),
    ("tokenizer letter", {"tokenizer": "letter"}, {}, BONE, "The QUICK Brown Foxes jumped over the lazy dog s bone".split()),
    ("tokenizer lowercase", {"tokenizer": "lowercase"}, {}, BONE, "the quick brown foxes jumped over the lazy dog s bone".split()),
    ("tokenizer whitespace", {"tokenizer": "whitespace"}, {}, BONE, BONE.split()),
    ("tokenizer ngram", {"tokenizer": "ngram"}, {}, "Quick Fox", ["Q", "Qu", "u", "ui", "i", "ic", "c", "ck", "k", "k ", " ", " F", "F", "Fo", "o", "ox", "x"]),
    ("tokenizer ngram of classes", {"analyzer": "mine"}, _custom({"type": "ngram", "min_gram": 3, "max_gram": 3, "token_chars": ["letter", "digit"]}), "2 Quick Foxes.", "Qui uic ick Fox oxe xes".split()),
    ("tokenizer edge_ngram", {"tokenizer": "edge_ngram"}, {}, "Quick Fox", ["Q", "Qu"]),
    ("tokenizer edge_ngram of classes", {"analyzer": "mine"}, _custom({"type": "edge_ngram", "min_gram": 2, "max_gram": 10, "token_chars": ["letter", "digit"]}), "2 Quick Foxes.", "Qu Qui Quic Quick Fo Fox Foxe Foxes".split()),
    ("tokenizer keyword", {"tokenizer": "keyword"}, {}, "New York", ["New York"]),
    ("tokenizer keyword with filter", {"tokenizer": "keyword", "token_filter": ["lowercase"]}, {}, "john.SMITH@example.COM", ["john.smith@example.com"]),
    ("tokenizer regexp", {"tokenizer": "regexp"}, {}, "The foo_bar_size's default is 5.", "The foo_bar_size s default is 5".split()),
    ("tokenizer regexp on commas", {"analyzer": "mine"}, _custom({"type": "pattern", "pattern": "[^,]+"}), "comma,separated,values", "comma separated values".split()),
    ("tokenizer regexp with quotes", {"analyzer": "mine"}, _custom({"type": "pattern", "pattern": r'((?:\\"|[^", ])+)'}), r'"value", "value with embedded \" quote"', ["value", "value", "with", "embedded", r"\"", "quote"]),
    ("tokenizer char_group", {"tokenizer": {"type": "char_group", "tokenize_on_chars": ["whitespace", "-", "\n"]}}, {}, "The QUICK brown-fox", "The QUICK brown fox".split()),
    ("tokenizer path_hierarchy", {"tokenizer": "path_hierarchy"}, {}, "/one/two/three", ["/one", "/one/two", "/one/two/three"]),
    ("tokenizer path_hierarchy with options", {"analyzer": "mine"}, _custom({"type": "path_hierarchy", "delimiter": "-", "replacement": "/", "skip": 2}), "one-two-three-four-five", ["/three", "/three/four", "/three/four/five"]),
    ("apostrophe", {"tokenizer": "standard", "filter": ["apostrophe"]}, {}, "Istanbul'a veya Istanbul'dan", "Istanbul veya Istanbul".split()),
    ("cjk_bigram", {"tokenizer": "standard", "filter": ["cjk_bigram"]}, {}, "東京都は、日本の首都であり", "東京 京都 都は 日本 本の の首 首都 都で であ あり".split()),
    ("cjk_width", {"tokenizer": "standard", "filter": ["cjk_width"]}, {}, "ｼｰｻｲﾄﾞﾗｲﾅｰ", ["シーサイドライナー"]),
    ("dict", {"tokenizer": "standard", "filter": [{"type": "dict", "words": ["Donau", "dampf", "meer", "schiff"]}]}, {}, "Donaudampfschiff", "Donaudampfschiff Donau dampf schiff".split()),
    ("edge_ngram", {"tokenizer": "standard", "filter": [{"type": "edge_ngram", "min_gram": 1, "max_gram": 2}]}, {}, "the quick brown fox jumps", "t th q qu b br f fo j ju".split()),
    ("ngram", {"tokenizer": "standard", "filter": ["ngram"]}, {}, "Quick fox", "Q Qu u ui i ic c ck k f fo o ox x".split()),
    ("elision", {"tokenizer": "standard", "filter": ["elision"]}, {}, "j’examine près du wharf", "examine près du wharf".split()),
    ("stemmer", {"tokenizer": "whitespace", "filter": ["stemmer"]}, {}, "fox running and jumping", "fox run and jump".split()),
    ("keyword filter", {"tokenizer": "whitespace", "filter": [{"type": "keyword", "keywords": ["jumping"]}, "stemmer"]}, {}, "fox running and jumping", "fox run and jumping".split()),
    ("length", {"tokenizer": "whitespace", "filter": [{"type": "length", "min": 0, "max": 4}]}, {}, "the quick brown fox jumps over the lazy dog", "the fox over the lazy dog".split()),
    ("lowercase", {"tokenizer": "standard", "filter": ["lowercase"]}, {}, "THE Quick FoX JUMPs", "the quick fox jumps".split()),
    ("pattern_replace", {"tokenizer": "whitespace", "filter": [{"type": "pattern_replace", "pattern": "(dog)", "replacement": "watch$1"}]}, {}, "foxes jump lazy dogs", "foxes jump lazy watchdogs".split()),
    ("reverse", {"tokenizer": "standard", "filter": ["reverse"]}, {}, "quick fox jumps", "kciuq xof spmuj".split()),
    ("shingle", {"tokenizer": "whitespace", "filter": ["shingle"]}, {}, "quick brown fox jumps", ["quick", "brown", "quick brown", "fox", "brown fox", "jumps", "fox jumps"]),
    ("stop filter", {"tokenizer": "standard", "filter": ["stop"]}, {}, FOX, "quick fox jumps lazy dog".split()),
    ("stop filter with words", {"tokenizer": "standard", "filter": [{"type": "stop", "stopwords": ["a", "the", "dog"]}]}, {}, FOX, "quick fox jumps over lazy".split()),
    ("stop filter of a language", {"tokenizer": "standard", "filter": [{"type": "stop", "stopwords": ["_english_"]}]}, {}, FOX, "quick fox jumps lazy dog".split()),
    ("trim", {"tokenizer": "keyword", "filter": ["trim"]}, {}, " fox ", ["fox"]),
    ("truncate", {"tokenizer": "whitespace", "filter": ["truncate"]}, {}, "the quinquennial extravaganza carried on", "the quinquenni extravagan carried on".split()),
    ("unique", {"tokenizer": "whitespace", "filter": ["unique"]}, {}, "the quick fox jumps the lazy fox", "the quick fox jumps lazy".split()),
    ("uppercase", {"tokenizer": "standard", "filter": ["uppercase"]}, {}, "the Quick FoX JUMPs", "THE QUICK FOX JUMPS".split()),
    ("asciifolding", {"tokenizer": "standard", "char_filter": ["asciifolding"]}, {}, "açaí à la carte", "acai a la carte".split()),
    ("html_strip", {"tokenizer": "standard", "char_filter": ["html_strip"]}, {}, "<p>I'm so <b>happy</b>!</p>", "I'm so happy".split()),
    ("mapping", {"tokenizer": "keyword", "char_filter": [{"type": "mapping", "mappings": DIGITS}]}, {}, "My license plate is ٢٥٠١٥", ["My license plate is 25015"]),
]
