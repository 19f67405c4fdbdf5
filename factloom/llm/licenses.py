"""License scans: ordered signature rules behind a keyword prefilter, with containment of overlapping detections."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile(f"{_WORD}+")
#: What may stand for a space of a signature: white space, with comment marks around a line break.
_SPACE = r"(?:\s[\s#*/;!>|%-]{0,24})"
_SPACES = re.compile(_SPACE)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

#: Phrases whose places count as base detections, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    """A signature: ``pattern`` over the lower-cased text, looked for only where ``keyword`` occurs.

    A space of either stands for any white space, and for line breaks with comment marks. The detection is the group
    named ``at``, or else the whole match. Of two detections of which one holds the other, the one of higher priority
    stays; of equals the longer one.
    """

    label: str
    priority: int
    keyword: str
    pattern: str

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.replace("[ -]", f"(?:{_SPACE}|-)").replace(" ?", f"{_SPACE}?").replace(" ", _SPACE))


#: label; name as written in running text (regular expression); a literal that each match holds; versions; registry name
FAMILIES = [
    ("mit", r"(?:the )?(?:mit|expat|x11) licen[sc]e", "licen", (), "mit"),
    ("mit-0", r"mit no attribution", "no attribution", (), "mit-0"),
    ("apache", r"(?:the )?apache(?: software)? licen[sc]e", "apache", ("1.0", "1.1", "2.0"), "apache"),
    ("gpl", r"(?:the )?(?:gnu )?general public licen[sc]e", "general public", ("1", "2", "2.0", "3", "3.0"), "gpl"),
    ("gpl", r"gnu gpl", "gnu gpl", ("2", "2.0", "3", "3.0"), "gpl"),
    ("lgpl", r"(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public", ("2", "2.0", "2.1", "3", "3.0"), "lgpl"),
    ("lgpl", r"gnu lgpl", "lgpl", ("2.1", "3", "3.0"), "lgpl"),
    ("agpl", r"(?:the )?(?:gnu )?affero general public licen[sc]e", "affero", ("1", "3", "3.0"), "agpl"),
    ("gfdl", r"(?:the )?(?:gnu )?free documentation licen[sc]e", "free documentation", ("1.1", "1.2", "1.3"), "gfdl"),
    ("bsd-2-clause", r"(?:the )?(?:2-clause|two-clause|simplified|freebsd) bsd(?: licen[sc]e)?", "bsd", (), "bsd-2-clause"),
    ("bsd-3-clause", r"(?:the )?(?:3-clause|three-clause|new|modified|revised) bsd(?: licen[sc]e)?", "bsd", (), "bsd-3-clause"),
    ("bsd-4-clause", r"(?:the )?(?:4-clause|four-clause|original) bsd(?: licen[sc]e)?", "bsd", (), "bsd-4-clause"),
    ("bsd", r"(?:the )?bsd(?:-style)? licen[sc]e", "bsd", (), "0bsd"),
    ("isc", r"(?:the )?isc licen[sc]e", "isc licen", (), "isc"),
    ("mpl", r"(?:the )?mozilla public licen[sc]e", "mozilla public", ("1.0", "1.1", "2.0"), "mpl"),
    ("epl", r"(?:the )?eclipse public licen[sc]e", "eclipse public", ("1.0", "2.0"), "epl"),
    ("edl", r"(?:the )?eclipse distribution licen[sc]e", "eclipse distribution", ("1.0",), "edl"),
    ("cddl", r"(?:the )?common development and distribution licen[sc]e", "common development", ("1.0", "1.1"), "cddl"),
    ("cpl", r"(?:the )?common public licen[sc]e", "common public", ("0.5", "1.0"), "cpl"),
    ("cpal", r"(?:the )?common public attribution licen[sc]e", "public attribution", ("1.0",), "cpal"),
    ("eupl", r"(?:the )?european union public licen[sc]e", "european union public", ("1.0", "1.1", "1.2"), "eupl"),
    ("artistic", r"(?:the )?(?:clarified )?artistic licen[sc]e", "artistic licen", ("1.0", "2.0"), "artistic"),
    ("bsl", r"(?:the )?boost software licen[sc]e", "boost software", ("1.0",), "bsl"),
    ("busl", r"(?:the )?business source licen[sc]e", "business source", ("1.0", "1.1"), "busl"),
    ("zlib", r"(?:the )?zlib(?:/libpng)? licen[sc]e", "zlib", (), "zlib"),
    ("libpng", r"(?:the )?libpng licen[sc]e", "libpng", ("1.0", "2.0"), "libpng"),
    ("psf", r"(?:the )?python software foundation licen[sc]e", "python software", ("2", "2.0"), "psf"),
    ("python", r"(?:the )?python licen[sc]e", "python licen", ("2.0",), "python"),
    ("php", r"(?:the )?php licen[sc]e", "php licen", ("3.0", "3.01"), "php"),
    ("ruby", r"(?:the )?ruby licen[sc]e", "ruby licen", (), "ruby"),
    ("zpl", r"(?:the )?zope public licen[sc]e", "zope public", ("1.1", "2.0", "2.1"), "zpl"),
    ("w3c", r"(?:the )?w3c(?: software)?(?: notice and)? licen[sc]e", "w3c", (), "w3c"),
    ("unicode", r"(?:the )?unicode(?: data files and software)? licen[sc]e", "unicode", ("3.0",), "unicode-dfs"),
    ("ofl", r"(?:the )?(?:sil )?open font licen[sc]e", "open font", ("1.0", "1.1"), "ofl"),
    ("osl", r"(?:the )?open software licen[sc]e", "open software licen", ("1.0", "1.1", "2.0", "2.1", "3.0"), "osl"),
    ("afl", r"(?:the )?academic free licen[sc]e", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0"), "afl"),
    ("ecl", r"(?:the )?educational community licen[sc]e", "educational community", ("1.0", "2.0"), "ecl"),
    ("ncsa", r"(?:the )?university of illinois/ncsa open source licen[sc]e", "ncsa", (), "ncsa"),
    ("postgresql", r"(?:the )?postgresql licen[sc]e", "postgresql licen", (), "postgresql"),
    ("vim", r"(?:the )?vim licen[sc]e", "vim licen", (), "vim"),
    ("wtfpl", r"(?:the )?do what the fuck you want to public licen[sc]e", "do what the fuck", ("2",), "wtfpl"),
    ("wtfpl", r"wtfpl", "wtfpl", ("2",), ""),
    ("unlicense", r"(?:the )?unlicen[sc]e", "unlicen", (), "unlicense"),
    ("ms-pl", r"(?:the )?microsoft public licen[sc]e", "microsoft public", (), "ms-pl"),
    ("ms-rl", r"(?:the )?microsoft reciprocal licen[sc]e", "microsoft reciprocal", (), "ms-rl"),
    ("apsl", r"(?:the )?apple public source licen[sc]e", "apple public", ("1.0", "1.1", "1.2", "2.0"), "apsl"),
    ("ipl", r"(?:the )?ibm public licen[sc]e", "ibm public", ("1.0",), "ipl"),
    ("npl", r"(?:the )?netscape public licen[sc]e", "netscape public", ("1.0", "1.1"), "npl"),
    ("qpl", r"(?:the )?q public licen[sc]e", "q public", ("1.0",), "qpl"),
    ("spl", r"(?:the )?sun public licen[sc]e", "sun public", ("1.0",), "spl"),
    ("lppl", r"(?:the )?latex project public licen[sc]e", "latex project", ("1.0", "1.1", "1.2", "1.3a", "1.3c"), "lppl"),
    ("cecill", r"(?:the )?cecill(?:-[bc])? licen[sc]e", "cecill", ("1.0", "2.0", "2.1"), "cecill"),
    ("mulanpsl", r"(?:the )?mulan(?: permissive software licen[sc]e| psl)", "mulan", ("1.0", "2.0"), "mulanpsl"),
    ("upl", r"(?:the )?universal permissive licen[sc]e", "universal permissive", ("1.0",), "upl"),
    ("sspl", r"(?:the )?server side public licen[sc]e", "server side public", ("1", "1.0"), "sspl"),
    ("elastic", r"(?:the )?elastic licen[sc]e", "elastic licen", ("1.0", "2.0"), "elastic"),
    ("polyform", r"(?:the )?polyform (?:noncommercial|small business|shield|strict) licen[sc]e", "polyform", ("1.0.0",), "polyform"),
    ("openssl", r"(?:the )?openssl licen[sc]e", "openssl licen", (), "openssl"),
    ("ijg", r"independent jpeg group(?:'s)? licen[sc]e", "independent jpeg", (), "ijg"),
    ("ftl", r"(?:the )?freetype(?: project)? licen[sc]e", "freetype", (), "ftl"),
    ("curl", r"(?:the )?curl licen[sc]e", "curl licen", (), "curl"),
    ("blueoak", r"(?:the )?blue oak model licen[sc]e", "blue oak", ("1.0.0",), "blueoak"),
    ("odbl", r"(?:the )?open (?:data commons )?(?:open )?database licen[sc]e", "database licen", ("1.0",), "odbl"),
    ("odc-by", r"(?:the )?open data commons attribution licen[sc]e", "open data commons", ("1.0",), "odc-by"),
    ("pddl", r"(?:the )?public domain dedication and licen[sc]e", "public domain dedication", ("1.0",), "pddl"),
    ("cc0", r"(?:creative commons )?(?:cc0|zero)(?: universal)?(?: public domain dedication)? licen[sc]e", "licen", ("1.0",), "cc0"),
    ("openrail", r"(?:the )?(?:creativeml )?open ?rail(?:-m|\+\+)? licen[sc]e", "rail", (), "openrail"),
    ("llama", r"(?:the )?llama(?: \d(?:\.\d)?)? community licen[sc]e", "llama", (), "llama"),
    ("hippocratic", r"(?:the )?hippocratic licen[sc]e", "hippocratic", ("2.1", "3.0"), "hippocratic"),
    ("json", r"(?:the )?json licen[sc]e", "json licen", (), "json"),
    ("beerware", r"(?:the )?beer-?ware licen[sc]e", "beer", (), "beerware"),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain", (), ""),
    ("proprietary", r"all rights reserved", "all rights reserved", (), ""),
    ("proprietary", r"proprietary and confidential", "proprietary", (), ""),
]

#: Sentences of license bodies and notices: label, keyword, pattern.
BODIES = [
    ("mit", "permission is hereby granted, free", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "the software is provided", r"the software is provided [\"“]?as is[\"”]?, without warranty of any kind, express or implied"),
    ("isc", "permission to use, copy, modify", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{0,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache", "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e"),
    ("gpl", "free software", r"this program is free software[:;,] you can redistribute it and/or modify"),
    ("lgpl", "free software", r"this library is free software[:;,] you can redistribute it and/or modify"),
    ("gpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", "gnu.org/licenses", r"gnu\.org/licenses/agpl"),
    ("apache", "apache.org/licenses", r"apache\.org/licenses/license-\d(?:\.\d)?"),
    ("mit", "opensource.org/license", r"opensource\.org/licenses?/mit"),
    ("bsd", "opensource.org/license", r"opensource\.org/licenses?/bsd"),
    ("mpl", "mozilla.org/mpl", r"mozilla\.org/mpl/\d(?:\.\d)?"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("bsl", "boost.org/license", r"boost\.org/license_1_0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors", r"in no event will the authors be held liable for any damages arising from the use"),
    ("cc0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
]


def rules() -> list[Rule]:
    """Some hundred rules, made from the families, the bodies, and the Creative Commons grid; first to last in order of
    priority."""
    out = []
    for label, name, keyword, versions, registry in FAMILIES:
        out.append(Rule(label, 50, keyword, rf"\b(?:{name})\b"))
        out.append(Rule(label, 70, keyword, rf"\b(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})\b"))
        for v in versions:
            out.append(Rule(f"{label}-{v}", 60, keyword, rf"\b(?:{name}),?(?: \(?[a-z]{{2,6}}\)?)?,? v(?:er(?:sion)?)?\.? ?{re.escape(v)}(?![.\d]*\d)"))
            out.append(Rule(f"{label}-{v}", 60, keyword, rf"\b(?:{name}),? \(?{re.escape(v)}(?![.\d]*\d)"))
        if registry:
            line = r"spdx-license-identifier:[^\n]*?(?<![\w.-])"  # an expression may name several
            out.append(Rule(label, 80, "spdx-license-identifier", rf"{line}(?P<at>{re.escape(registry)})(?![a-z])"))
            for v in versions:
                out.append(Rule(f"{label}-{v}", 90, "spdx-license-identifier", rf"{line}(?P<at>{re.escape(registry)}-{re.escape(v)}(?:-only|-or-later|\+)?)(?![.\d]*\d)"))
    for label, keyword, pattern in BODIES:
        out.append(Rule(label, 75, keyword, pattern))
    grid = {"by": "attribution", "by-sa": "attribution[ -]sharealike", "by-nd": "attribution[ -]noderiv(?:ative)?s?", "by-nc": "attribution[ -]noncommercial", "by-nc-sa": "attribution[ -]noncommercial[ -]sharealike", "by-nc-nd": "attribution[ -]noncommercial[ -]noderiv(?:ative)?s?"}
    for code, name in grid.items():
        out.append(Rule(f"cc-{code}", 65, "creative commons", rf"creative commons {name}(?![ -](?:sharealike|noncommercial|noderiv))"))
        out.append(Rule(f"cc-{code}", 80, "creativecommons.org", rf"creativecommons\.org/licenses/{code}/"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(Rule(f"cc-{code}-{v}", 70, "cc", rf"\bcc[ -]{code}[ -]{re.escape(v)}\b"))
            out.append(Rule(f"cc-{code}-{v}", 85, "creativecommons.org", rf"creativecommons\.org/licenses/{code}/{re.escape(v)}"))
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = [(r, r.compiled()) for r in rules()]
        by_keyword: dict[str, list[int]] = {}
        for k, (r, _) in enumerate(self.rules):
            by_keyword.setdefault(r.keyword, []).append(k)
        self.gate = ahocorasick.Automaton()
        for keyword, of in by_keyword.items():
            self.gate.add_word(keyword, of)
        self.gate.make_automaton()
        self.base = [(re.compile(f"(?<!{_WORD})" + _GAP.join(p.split()) + f"(?!{_WORD})"), label) for p, label in BASE.items()]

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """Start, end and rule of what stays, by place, in the lower-cased ``text``."""
        wanted = {k for _, of in self.gate.iter(_SPACES.sub(" ", text)) for k in of}
        found = []
        for k in wanted:
            rule, pattern = self.rules[k]
            group = "at" if "at" in pattern.groupindex else 0
            found += [(*m.span(group), rule, k) for m in pattern.finditer(text)]
        found.sort(key=lambda d: (d[0], d[1]))
        kept: list[tuple[int, int, Rule]] = []
        run: list[tuple[int, int, Rule, int]] = []  # detections that overlap in a chain: only these can hold each other
        for d in found:
            if run and d[0] >= max(x[1] for x in run):
                kept += self._settled(run)
                run = []
            run.append(d)
        return sorted(kept + self._settled(run), key=lambda d: (d[0], d[1], d[2].label))

    @staticmethod
    def _settled(run: list[tuple[int, int, Rule, int]]) -> list[tuple[int, int, Rule]]:
        kept: list[tuple[int, int, Rule]] = []
        for start, end, rule, _ in sorted(run, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[3])):
            if not any(a <= start and end <= b or start <= a and b <= end for a, b, _ in kept):
                kept.append((start, end, rule))
        return kept

    def scan(self, text: str | None) -> dict:
        text = (text or "").translate(_LOWER)
        base = [(m.start(), label) for pattern, label in self.base for m in pattern.finditer(text)] if "license" in text else []
        kept = self.detections(text)
        places = sorted(p for p, _ in base)
        names = sorted({label for _, label in base})
        score = max([r.priority / 100 for _, _, r in kept] + [0.5 for _ in base[:1]], default=0.0)
        return {
            "n_words": sum(1 for _ in _WORDS.finditer(text)),
            "n_base": len(base),
            "first_word": len(_WORDS.findall(text, 0, places[0])) if places else None,
            "last_word": len(_WORDS.findall(text, 0, places[-1])) if places else None,
            "base_labels": ",".join(names),
            "labels": ",".join(sorted({*names, *(r.label for _, _, r in kept)})),
            "score": score,
            "spans": [{"start": a, "stop": b, "label": r.label} for a, b, r in kept],
        }


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def license_scan(docs: DataFrame) -> DataFrame:
    """Licenses named in each whole text of ``docs(doc_id, text)``; every row comes back, other columns are ignored.

    A to Z are lower-cased; a null text is empty. doc_id; n_words; n_base, the places of the base phrases (their words
    one after the other); first_word and last_word, their least and greatest start in words (null without one);
    base_labels and labels, distinct, sorted and joined by commas; score from 0 (nothing found) to 1, the priority of
    the surest detection; spans of all detections that stay, in code points of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches:
            rows = [scan(t) for t in batch.column("text").to_pylist()]
            types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            types["spans"] = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[c] for r in rows], t) for c, t in types.items())], ["doc_id", *types])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,stop:int,label:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
