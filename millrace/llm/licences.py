"""License scans: an Aho-Corasick automaton over normalised words, and licence expressions.

A text's words (A-Z lower-cased) are joined by single spaces, so one pass of the
automaton finds every place where a phrase's words stand consecutively,
overlapping ones included, and the words of identifier tags, whose spelling and
expression are then read from the text. A shunting-yard parser brings
expressions to postfix order and evaluates them against a policy. The score is
one less the product of what each label leaves open, by the weights below.

Defined results: null and empty texts have no words, no labels, null first and
last word and score 0. A malformed expression counts as a tag of its
identifiers and is not permitted. Rows are scanned independently; only doc_id
and text are read.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .runtime import ASCII_FOLD, ITEM_WORD

#: Phrases that the contract names, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases of this scanner, with labels and how surely they mark a licence.
NOTICES = {
    "mit license": ("mit", 0.8), "released under the mit": ("mit", 0.8), "permission is hereby granted free of charge": ("mit", 0.7),
    "apache license": ("apache-2.0", 0.8), "licensed under the apache": ("apache-2.0", 0.8),
    "lesser general public license": ("lgpl", 0.9), "affero general public license": ("agpl", 0.9), "gnu general public license": ("gpl", 0.9),
    "mozilla public license": ("mpl-2.0", 0.8), "eclipse public license": ("epl", 0.8), "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.8), "boost software license": ("bsl-1.0", 0.8),
    "isc license": ("isc", 0.7), "zlib license": ("zlib", 0.7), "artistic license": ("artistic", 0.7), "the unlicense": ("unlicense", 0.7), "academic free license": ("afl", 0.7),
    "open software license": ("osl", 0.7), "european union public licence": ("eupl", 0.8), "common development and distribution license": ("cddl", 0.8), "microsoft public license": ("ms-pl", 0.8),
    "sil open font license": ("ofl", 0.8), "open font license": ("ofl", 0.7), "gnu free documentation license": ("gfdl", 0.9), "open data commons": ("odc", 0.7), "open database license": ("odbl", 0.8),
    "do what the fuck you want to public license": ("wtfpl", 0.9), "python software foundation license": ("psf", 0.8), "postgresql license": ("postgresql", 0.8), "business source license": ("busl", 0.8), "server side public license": ("sspl", 0.9),
    "without warranty of any kind": ("disclaimer", 0.4), "provided as is": ("disclaimer", 0.3), "all rights not granted": ("proprietary", 0.4), "used with permission": ("permission", 0.3),
    "cc by sa": ("cc-by-sa", 0.8), "cc by nc": ("cc-by-nc", 0.8), "cc by nd": ("cc-by-nd", 0.8), "cc0": ("cc0", 0.7),
    "creative commons attribution": ("cc-by", 0.7), "creative commons": ("creative-commons", 0.6), "public domain": ("public-domain", 0.4),
    "licensed under": ("notice", 0.4), "released under": ("notice", 0.3), "distributed under the terms of": ("notice", 0.4), "copyright": ("copyright", 0.3), "proprietary and confidential": ("proprietary", 0.7),
}
BASE_WEIGHT, TAG_WEIGHT = 0.5, 0.95
#: The words of an identifier tag, and how it stands in a text, A-Z lower-cased.
TAG_PHRASE, TAG_FORM = "spdx license identifier", "spdx-license-identifier"
EXPRESSION = re.compile(r":[ \t]*([A-Za-z0-9.+\-() \t]+)")
#: Licences that the default policy permits, lower case.
PERMITTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "zlib", "unlicense", "cc0-1.0", "bsl-1.0", "cc-by-4.0", "cc-by-3.0", "postgresql", "python-2.0"})
#: Exceptions that may follow a licence after "with", lower case.
EXCEPTIONS = frozenset("""
389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0
ecos-exception-2.0 fawkes-runtime-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception
gpl-cc-1.0 i2p-gpl-java-exception libtool-exception linux-syscall-note llvm-exception lzma-exception mif-exception ocaml-lgpl-linking-exception
openjdk-assembly-exception-1.0 openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 swift-exception
u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())
BINDING = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """The expression's identifiers and operators in postfix order; ValueError if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for token in re.findall(r"[()]|[^\s()]+", expression):
        word = token.lower()
        if (word in BINDING or word == ")") == operand:
            raise ValueError(f"unexpected {token!r} in {expression!r}")
        if word == "(":
            stack.append(word)
        elif word == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(f"unbalanced ) in {expression!r}")
            stack.pop()
        elif word in BINDING:
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            out.append(token)
            operand = False
    while stack:
        if stack[-1] == "(":
            raise ValueError(f"unbalanced ( in {expression!r}")
        out.append(stack.pop())
    if operand:
        raise ValueError(f"incomplete {expression!r}")
    return out


def permitted(expression: str, policy: frozenset[str] = PERMITTED) -> bool:
    """Whether the policy lets one use what is under the expression: or needs either side, and both; an exception (with) needs the licence before it, and to be a known one."""
    stack: list[bool] = []
    tokens = postfix(expression)
    for k, token in enumerate(tokens):
        if (op := token.lower()) in BINDING:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if op == "or" else left and right)
        else:
            # What follows "with" stands right before it in postfix order; only there does an exception count.
            after_with = k + 1 < len(tokens) and tokens[k + 1].lower() == "with"
            stack.append(op in EXCEPTIONS if after_with else op.rstrip("+") in policy)
    return stack[0]


def tag_expression(raw: str) -> str:
    """The longest well-formed expression at the start of what follows a tag; else its first word."""
    tokens = re.findall(r"[()]|[^\s()]+", raw)
    best, n = "", 0
    while n < len(tokens):
        n += 1
        try:
            postfix(" ".join(tokens[:n]))
        except ValueError:
            if n > 1 and tokens[n - 1].lower() not in {*BINDING, "(", ")"} and tokens[n - 2].lower() not in {*BINDING, "("}:
                break
            continue
        best = " ".join(tokens[:n])
    return best or next((t for t in tokens if t not in "()"), "")


def tagged(text: str, places: list[int]) -> list[str]:
    """The expressions of the identifier tags whose words start at these places (in words)."""
    low = text.translate(ASCII_FOLD)
    spans = [m.span() for m in re.finditer(ITEM_WORD, low)]
    out = []
    for k in places:
        end = spans[k + len(TAG_PHRASE.split()) - 1][1]
        if low[spans[k][0] : end] == TAG_FORM and (m := EXPRESSION.match(text, end)):
            out.append(tag_expression(m[1]))
    return out


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in BASE_PHRASES.keys() | NOTICES.keys() | {TAG_PHRASE}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, expressions, permitted (null without expressions), score."""
    words = re.findall(ITEM_WORD, text.translate(ASCII_FOLD) if not text.isascii() else text.lower())
    line = f" {' '.join(words)} "
    hits = [(end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(line)]
    base, labels, doubt = [], {}, 1.0
    tags = []
    if hits:
        starts = list(accumulate((len(w) + 1 for w in words[:-1]), initial=0))
        for at, phrase in hits:
            if phrase == TAG_PHRASE:
                tags.append(bisect_right(starts, at) - 1)
                continue
            if phrase in BASE_PHRASES:
                base.append((bisect_right(starts, at) - 1, BASE_PHRASES[phrase]))
            label, weight = NOTICES.get(phrase) or (BASE_PHRASES[phrase], BASE_WEIGHT)
            labels[label] = max(labels.get(label, 0), weight)
    expressions = tagged(text, tags) if tags else []
    fit = []
    for e in filter(None, expressions):
        try:
            ids = [t for t in postfix(e) if t.lower() not in BINDING]
            fit.append(permitted(e))
        except ValueError:
            ids = [e]
            fit.append(False)
        labels |= {i.lower(): TAG_WEIGHT for i in ids}
    for weight in labels.values():
        doubt *= 1 - weight
    places = [w for w, _ in base]
    join = lambda x: ",".join(sorted(set(x)))
    return len(words), len(base), min(places, default=None), max(places, default=None), join(x for _, x in base), join(labels), "; ".join(filter(None, expressions)), all(fit) if fit else None, 1 - doubt


COLUMNS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "expressions": "string", "permitted": "boolean", "score": "double"}


def scan_documents(docs: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([scan(t or "") for t in frame["text"]], columns=list(COLUMNS)).astype({"first_word": "Int64", "last_word": "Int64"})
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64"))
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))
