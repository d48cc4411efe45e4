"""Licence recognition by sentences and ordered rules over their identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, texts

#: Known licence sentences, normalised, and their identifiers. V stands for a version number, which is kept, NAME for up to NAME_WORDS words (a holder), SUBJECT
#: for as many before a verb (a program), where a paragraph has what _ANCHOR says. [a|b]: one of these, or nothing; (a|b): one of these.
TEMPLATES = {
    "[this file is] licensed under the apache license version V [the license]": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopyAt",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis [without warranties or conditions of any kind either express or implied]": "ApacheAsIs",
    "[this project is|this software is|this work is|this library is|this code is] (licensed|released|distributed) under [the terms of] the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions]": "MitGrant",
    "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied [including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement]": "MitAsIs",
    "permission to use copy modify (and/or|and) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify (and/or|and) distribute this software for any purpose with or without fee is hereby granted": "ZeroBsdGrant",
    "the software is provided as is and NAME (disclaims|disclaim) all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscAsIs",
    "this is free and unencumbered software released into the public domain": "UnlicenseFree",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means": "UnlicenseAnyone",
    "this work is licensed under the gnu general public license version V": "GplRef",
    "this work is licensed under the gnu lesser general public license version V": "LgplRef",
    "this work is licensed under the gnu affero general public license version V": "AgplRef",
    "either version V of the license or at your option any later version": "GplOrLater",
    "version V of the license": "GplVersion",
    "SUBJECT (is|are) distributed in the hope that it will be useful but without any warranty": "GplNoWarranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdPermit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BsdBinary",
    "all advertising materials mentioning features or use of this software must display the following (acknowledgement|acknowledgment)": "BsdAdvert",
    "this product includes software developed by NAME": "BsdAdvertText",
    "neither the (name|names) of NAME nor the names of (its|their|any|other|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "the (name|names) of NAME may not be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "[this work is] licensed under cc by V": "CcBy",
    "[this work is] licensed under cc by-sa V": "CcBySa",
    "[this work is] licensed under cc by-nc V": "CcByNc",
    "[this work is] licensed under cc by-nd V": "CcByNd",
    "[this work is] licensed under cc by-nc-sa V": "CcByNcSa",
    "[this work is] licensed under cc by-nc-nd V": "CcByNcNd",
    "this work is dedicated to the public domain": "PublicDomain",
    "this source code form is subject to the terms of the mozilla public license v V": "MplRef",
    "this program and the accompanying materials are made available under the terms of the eclipse public license [version|v] V [which accompanies this distribution and is available at|which accompanies this distribution|which is available at]": "EplTerms",
    "all rights reserved": "AllRights",
}
#: What the notices of the GNU licences differ in, and the parts of their common sentences.
GNU = {"general": "Gpl", "lesser general": "Lgpl", "library general": "Lgpl", "affero general": "Agpl"}
#: The long names of the Creative Commons licences.
COMMONS = {"attribution": "CcBy", "attribution-sharealike": "CcBySa", "attribution-noncommercial": "CcByNc", "attribution-(noderivatives|noderivs)": "CcByNd", "attribution-noncommercial-sharealike": "CcByNcSa", "attribution-noncommercial-(noderivatives|noderivs)": "CcByNcNd"}
TEMPLATES |= {f"SUBJECT (is|are) free software you can redistribute it and/or modify it under the terms of the gnu {kind} public license as published by the free software foundation": f"{name}Free" for kind, name in GNU.items()}
TEMPLATES |= {f"SUBJECT (is|are) free software you can redistribute it and/or modify it under the terms of the gnu {kind} public license as published by the free software foundation either version V of the license or at your option any later version": f"{name}FreeOrLater" for kind, name in GNU.items()}
TEMPLATES |= {f"SUBJECT (is|are) free software you can redistribute it and/or modify it under the terms of the gnu {kind} public license as published by the free software foundation version V of the license": f"{name}FreeOnly" for kind, name in GNU.items()}
TEMPLATES |= {f"SUBJECT (is|are) free software you can redistribute it and/or modify it under the terms of the gnu {kind} public license version V [only] as published by the free software foundation": f"{name}FreeOnly" for kind, name in GNU.items()}
TEMPLATES |= {f"[this work is licensed under|licensed under|released under] [a|the] creative commons {kind} V [international|unported|generic] [public] [license]": name for kind, name in COMMONS.items()}


def expanded(template: str) -> list[str]:
    """A template's sentences, without brackets."""
    if not (m := re.search(r"\[([^\[\]]*)\]|\(([^()]*)\)", template)):
        return [" ".join(template.split())]
    choices = [*m[1].split("|"), ""] if m[1] is not None else m[2].split("|")
    return [x for c in choices for x in expanded(template[: m.start()] + c + template[m.end() :])]


SENTENCES = {sentence: name for template, name in TEMPLATES.items() for sentence in expanded(template)}
#: Licence rules, tried in this order at each place; a rule is a run of identifiers. V: the version of the run's first sentence that has one.
RULES = (
    ("BSD-4-Clause", ("BsdPermit", "BsdSource", "BsdBinary", "BsdAdvert", "BsdAdvertText", "BsdEndorse")),
    ("BSD-3-Clause", ("BsdPermit", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdPermit", "BsdSource", "BsdBinary")),
    ("Apache-V", ("ApacheRef", "ApacheCompliance", "ApacheCopyAt", "ApacheAsIs")),
    ("Apache-V", ("ApacheRef", "ApacheCompliance")),
    ("Apache-V", ("ApacheRef",)),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitRef",)),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroBsdGrant", "IscAsIs")),
    ("0BSD", ("ZeroBsdGrant",)),
    ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone")),
    ("Unlicense", ("UnlicenseFree",)),
    *((f"{kind.upper()}-V-{end}", run + tail) for kind in ("Gpl", "Lgpl", "Agpl") for end, run in (("or-later", (f"{kind}Free", "GplOrLater")), ("or-later", (f"{kind}FreeOrLater",)), ("only", (f"{kind}Free", "GplVersion")), ("only", (f"{kind}FreeOnly",))) for tail in (("GplNoWarranty",), ())),
    ("GPL-V", ("GplRef",)),
    ("LGPL-V", ("LgplRef",)),
    ("AGPL-V", ("AgplRef",)),
    ("CC-BY-NC-ND-V", ("CcByNcNd",)),
    ("CC-BY-NC-SA-V", ("CcByNcSa",)),
    ("CC-BY-NC-V", ("CcByNc",)),
    ("CC-BY-ND-V", ("CcByNd",)),
    ("CC-BY-SA-V", ("CcBySa",)),
    ("CC-BY-V", ("CcBy",)),
    ("MPL-V", ("MplRef",)),
    ("EPL-V", ("EplTerms",)),
    ("Public-Domain", ("PublicDomain",)),
    ("All-Rights-Reserved", ("AllRights",)),
)
#: The identifier of a tag that names licences itself, with its expression in place of a version.
TAG = "SpdxTag"
NAME_WORDS = 12
SCAN = "doc_id long, n_sentences long, sentence_ids array<string>, licenses array<string>, unmatched array<string>"
_END = re.compile(r"[.!?;:](?=\s|$)|\n+")
#: An empty line, or one of comment signs alone.
_GAP = re.compile(r"\n[\s#*/;-]*\n")
_URL = re.compile(r"(https?://\S+)", re.I)
_BULLET = re.compile(r"^\W*(?:\d+|[a-z])\)\s+")
_PLAIN = re.compile(r"[^a-z0-9./\-]+|(?<!\d)\.|\.(?!\d)")
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*)")
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*((?:\(|[A-Za-z0-9.+-])(?:[A-Za-z0-9.+() -]*[A-Za-z0-9.+)])?)", re.I)
_ANCHOR = re.compile("free software you can redistribute|distributed in the hope that")


def _split(text: str) -> list[str]:
    return [s for part in _END.split(text) if (s := part.strip())]


def _plain(part: str) -> str:
    """A part of a sentence without letter case, punctuation, excess white space, and what a comment or list puts before it."""
    return " ".join(_PLAIN.sub(" ", _BULLET.sub("", part.lower())).split()).strip(" -/")


def _tree() -> dict:
    """Known sentences word by word; under None, the identifier of one that ends."""
    root: dict = {}
    for sentence, name in SENTENCES.items():
        node = root
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[None] = name
    return root


_ROOT = _tree()
_PLAIN_ROOT = {word: node for word, node in _ROOT.items() if word != "SUBJECT"}
#: (place in the tree, words of a name so far, version): where a sentence can be.
State = tuple[dict, int, str]


def _step(states: list[State], word: str) -> list[State]:
    out: list[State] = []
    number = _VERSION.fullmatch(word)
    for node, named, version in states:
        if word in node:
            out.append((node[word], 0, version))
        if number and "V" in node:
            out.append((node["V"], 0, version or number[1]))
        out += [(node[slot], 1, version) for slot in ("NAME", "SUBJECT") if slot in node]
        if 0 < named < NAME_WORDS:
            out.append((node, named + 1, version))
    return out


def _sentence(parts: list[tuple[str, bool]], at: int, root: dict) -> tuple[str, str, int] | None:
    """(identifier, version, parts) of the known sentence that the parts from this place on make up, if they do."""
    states: list[State] = [(root, 0, "")]
    for k in range(at, len(parts)):
        for word in parts[k][0].split():
            if not (states := _step(states, word)):
                return None
        for node, _, version in states:
            if None in node:
                return node[None], version, k + 1 - at
    return None


def scan(text: str) -> tuple[int, list[tuple[str, str]]]:
    """The number of a text's sentences, and the identifiers of the known ones with their versions ('' if there is none).

    Text is parted at .!?;: before white space, at line feeds and around addresses (which don't count as ends). Parts in a row, within a paragraph, that make up a known sentence are one,
    however it is wrapped or punctuated; any other part counts as a sentence. A tag that names its licences is a sentence of its own.
    """
    count, known = 0, []
    for paragraph in _GAP.split(text):
        for k, stretch in enumerate(_TAG.split(paragraph)):
            if k % 2:
                count += 1
                known.append((TAG, stretch))
                continue
            pieces = [[p for p in _URL.split(s) if p.strip()] for s in _split(stretch)]
            parts = [(_plain(p), not j) for own in pieces for j, p in enumerate(own)]
            root, at = _ROOT if _ANCHOR.search(" ".join(p for p, _ in parts)) else _PLAIN_ROOT, 0
            while at < len(parts):
                found = _sentence(parts, at, root)
                if found:
                    known.append(found[:2])
                count += parts[at][1]
                at += found[2] if found else 1
    return count, known


def recognise(known: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Licences in the order of their runs, each once, and the identifiers that no rule takes."""
    licenses: dict[str, None] = {}
    rest, at = [], 0
    while at < len(known):
        if known[at][0] == TAG:
            licenses |= dict.fromkeys(x for x in re.findall(r"[A-Za-z0-9.+-]+", known[at][1]) if x.upper() not in ("AND", "OR", "WITH"))
            at += 1
            continue
        for name, run in RULES:
            own = known[at : at + len(run)]
            if tuple(k for k, _ in own) == run:
                version = next((v for _, v in own if v), "")
                licenses[name.replace("-V", f"-{version}" if version else "")] = None
                at += len(run)
                break
        else:
            rest.append(known[at][0])
            at += 1
    return list(licenses), rest


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            count, known = scan(text)
            rows.append((doc, count, [k for k, _ in known], *recognise(known)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.string())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_sentences", "sentence_ids", "licenses", "unmatched"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences that each document's sentences state.

    Returns a row per document: doc_id, n_sentences, sentence_ids (of known licence sentences, in order, repeats
    included), licenses (each once, in order), unmatched (identifiers that no rule takes).

    Each sentence, wrapped over lines or not, is normalised and looked up, word by word, among the known ones, in which holders and programs may have any names; the sequence of identifiers is matched against the ordered
    rules, the first that fits at a place wins, and matching goes on behind it. A text is read by one task, without a shuffle.

    Null and empty texts have no sentences and no licences. Repeated rows each give a row. An
    empty table gives no rows.
    """
    return texts(docs, id_col, text_col).mapInArrow(_scan, SCAN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
