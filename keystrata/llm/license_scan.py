"""License detection: ordered signature rules behind a keyword prefilter.

About seventy licence families times four forms (identifier tag, grant, address, name) and sentences from the bodies of
licences give some hundreds of regular expressions. One Aho-Corasick pass over a text finds which literals occur; an
expression runs only where all literals that any match of it must hold are there. Overlapping detections are settled by
priority and containment.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import PLAIN, blocks, words

W = r"0-9a-z\x80-\U0010FFFF"
#: Phrases whose words stand consecutively, and their labels.
BASE = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))
#: label | keywords, all words of one of which every alternative of the name holds | name as an expression | SPDX identifiers | address (a part of it)
FAMILIES = r"""
apache-2.0 | apache | apache (software )?licen[sc]e,? (version )?2(\.0)? | apache-2\.0 | apache\.org/licenses/license-2\.0
apache-1.1 | apache | apache (software )?licen[sc]e,? (version )?1\.1 | apache-1\.1 | apache\.org/licenses/license-1\.1
apache-1.0 | apache | apache (software )?licen[sc]e,? (version )?1\.0 | apache-1\.0 | apache\.org/licenses/license-1\.0
mit | mit | (the )?mit licen[sc]e | mit | opensource\.org/licenses?/mit
mit-0 | mit | mit no attribution( licen[sc]e)? | mit-0 | opensource\.org/licenses?/mit-0
x11 | x11 | x11 licen[sc]e | x11 | xfree86\.org/legal/licenses
bsd-2-clause | bsd | (simplified|2-clause|two-clause|freebsd) bsd licen[sc]e | bsd-2-clause | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd | (new|modified|revised|3-clause|three-clause) bsd licen[sc]e | bsd-3-clause | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd | (original|4-clause|four-clause) bsd licen[sc]e | bsd-4-clause | directory\.fsf\.org/wiki/license:bsd-4-clause
0bsd | bsd | (zero-clause|0-clause) bsd( licen[sc]e)? | 0bsd | opensource\.org/licenses?/0bsd
isc | isc | isc licen[sc]e | isc | opensource\.org/licenses?/isc
gpl-1.0 | general public | gnu general public licen[sc]e,? (version |v)1(\.0)? | gpl-1\.0(-only|-or-later|\+)? | gnu\.org/licenses/(old-licenses/)?gpl-1
gpl-2.0 | general public | gnu general public licen[sc]e,? (version |v)2(\.0)? | gpl-2\.0(-only|-or-later|\+)? | gnu\.org/licenses/(old-licenses/)?gpl-2
gpl-3.0 | general public | gnu general public licen[sc]e,? (version |v)3(\.0)? | gpl-3\.0(-only|-or-later|\+)? | gnu\.org/licenses/gpl-3
lgpl-2.0 | general public | gnu library general public licen[sc]e,? (version |v)2(\.0)? | lgpl-2\.0(-only|-or-later|\+)? | gnu\.org/licenses/(old-licenses/)?lgpl-2\.0
lgpl-2.1 | general public | gnu lesser general public licen[sc]e,? (version |v)2\.1 | lgpl-2\.1(-only|-or-later|\+)? | gnu\.org/licenses/(old-licenses/)?lgpl-2\.1
lgpl-3.0 | general public | gnu lesser general public licen[sc]e,? (version |v)3(\.0)? | lgpl-3\.0(-only|-or-later|\+)? | gnu\.org/licenses/lgpl-3
agpl-1.0 | general public | affero general public licen[sc]e,? (version |v)1(\.0)? | agpl-1\.0(-only|-or-later|\+)? | affero\.org/oagpl
agpl-3.0 | general public | (gnu )?affero general public licen[sc]e,? (version |v)3(\.0)? | agpl-3\.0(-only|-or-later|\+)? | gnu\.org/licenses/agpl-3
gfdl-1.1 | free documentation | gnu free documentation licen[sc]e,? (version |v)1\.1 | gfdl-1\.1(-only|-or-later)? | gnu\.org/licenses/(old-licenses/)?fdl-1\.1
gfdl-1.2 | free documentation | gnu free documentation licen[sc]e,? (version |v)1\.2 | gfdl-1\.2(-only|-or-later)? | gnu\.org/licenses/(old-licenses/)?fdl-1\.2
gfdl-1.3 | free documentation | gnu free documentation licen[sc]e,? (version |v)1\.3 | gfdl-1\.3(-only|-or-later)? | gnu\.org/licenses/fdl-1\.3
mpl-1.0 | mozilla | mozilla public licen[sc]e,? (version |v)?1\.0 | mpl-1\.0 | mozilla\.org/mpl/1\.0
mpl-1.1 | mozilla | mozilla public licen[sc]e,? (version |v)?1\.1 | mpl-1\.1 | mozilla\.org/mpl/1\.1
mpl-2.0 | mozilla | mozilla public licen[sc]e,? (version |v)?2\.0 | mpl-2\.0 | mozilla\.org/mpl/2\.0
epl-1.0 | eclipse | eclipse public licen[sc]e,? (version |v|- v )?1\.0 | epl-1\.0 | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse | eclipse public licen[sc]e,? (version |v|- v )?2\.0 | epl-2\.0 | eclipse\.org/legal/epl-(2\.0|v20)
cddl-1.0 | common development | common development and distribution licen[sc]e,? (version )?1\.0 | cddl-1\.0 | opensource\.org/licenses?/cddl-1\.0
cddl-1.1 | common development | common development and distribution licen[sc]e,? (version )?1\.1 | cddl-1\.1 | oracle\.com/.{0,40}cddl-1\.1
cpl-1.0 | common public | common public licen[sc]e,? (version )?1\.0 | cpl-1\.0 | opensource\.org/licenses?/cpl1\.0
ipl-1.0 | ibm public | ibm public licen[sc]e,? (version )?1\.0 | ipl-1\.0 | opensource\.org/licenses?/ibmpl
eupl-1.1 | european union | european union public licen[sc]e,? (version |v\.? ?)?1\.1 | eupl-1\.1 | ec\.europa\.eu/.{0,40}eupl.?v?1\.1
eupl-1.2 | european union | european union public licen[sc]e,? (version |v\.? ?)?1\.2 | eupl-1\.2 | joinup\.ec\.europa\.eu/.{0,60}eupl
artistic-1.0 | artistic | artistic licen[sc]e,? (version )?1\.0 | artistic-1\.0(-perl|-cl8)? | opensource\.org/licenses?/artistic-license-1\.0
artistic-2.0 | artistic | artistic licen[sc]e,? (version )?2\.0 | artistic-2\.0 | opensource\.org/licenses?/artistic-license-2\.0
bsl-1.0 | boost | boost software licen[sc]e,?( (- )?version 1\.0)? | bsl-1\.0 | boost\.org/license_1_0
zlib | zlib | zlib licen[sc]e | zlib | opensource\.org/licenses?/zlib
libpng | png | (png reference library licen[sc]e|libpng licen[sc]e) | libpng(-2\.0)? | libpng\.org/pub/png/src/libpng-license
openssl | openssl | openssl licen[sc]e | openssl | openssl\.org/source/license
python-2.0 | python software | python software foundation licen[sc]e | (python-2\.0|psf-2\.0) | docs\.python\.org/.{0,20}license
ruby | ruby | ruby('s)? licen[sc]e | ruby | ruby-lang\.org/.{0,20}license
php-3.01 | php licen | php licen[sc]e,?( version 3\.01?)? | php-3\.0 ?1? | php\.net/license
w3c | w3c | w3c software (notice and )?licen[sc]e | w3c | w3\.org/consortium/legal/.{0,30}software
unicode | unicode | unicode(,? inc\.)? licen[sc]e agreement | unicode-(dfs-2015|dfs-2016|tou) | unicode\.org/(copyright|license)
ofl-1.1 | open font | sil open font licen[sc]e,?( version 1\.1)? | ofl-1\.[01] | scripts\.sil\.org/ofl
unlicense | unlicense | the unlicense | unlicense | unlicense\.org
wtfpl | want public | do what the f[a-z*]+ you want to public licen[sc]e | wtfpl | wtfpl\.net
beerware | beer | beer-?ware licen[sc]e | beerware | people\.freebsd\.org/~phk
postgresql | postgresql | postgresql licen[sc]e | postgresql | opensource\.org/licenses?/postgresql
ncsa | ncsa | (university of illinois/)?ncsa open source licen[sc]e | ncsa | otm\.illinois\.edu/.{0,30}license
afl-3.0 | academic free | academic free licen[sc]e,? (version |v\.? ?)?3\.0 | afl-3\.0 | opensource\.org/licenses?/afl-3\.0
osl-3.0 | open software | open software licen[sc]e,? (version |v\.? ?)?3\.0 | osl-3\.0 | opensource\.org/licenses?/osl-3\.0
ms-pl | microsoft public | microsoft public licen[sc]e | ms-pl | opensource\.org/licenses?/ms-pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e | ms-rl | opensource\.org/licenses?/ms-rl
upl-1.0 | universal permissive | universal permissive licen[sc]e,?( (version |v)?1\.0)? | upl-1\.0 | opensource\.org/licenses?/upl
mulan-2.0 | mulan | mulan (permissive software licen[sc]e|psl),?( v(ersion )?2)? | mulanpsl-2\.0 | license\.coscl\.org\.cn/mulanpsl2
elastic-2.0 | elastic | elastic licen[sc]e,? (version )?2(\.0)? | elastic-2\.0 | elastic\.co/licensing/elastic-license
sspl-1.0 | server side | server side public licen[sc]e,?( (version |v)1)? | sspl-1\.0 | mongodb\.com/licensing/server-side-public-license
busl-1.1 | business source | business source licen[sc]e,?( (version )?1\.1)? | busl-1\.1 | mariadb\.com/bsl11
cc0-1.0 | cc0 | cc0( 1\.0)?( universal)? | cc0-1\.0 | creativecommons\.org/publicdomain/zero
cc-by-4.0 | cc, creative | (cc[ -]by|creative commons attribution)( international)?( licen[sc]e)?,?( version)?[ -]4\.0 | cc-by-4\.0 | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | cc, creative | (cc[ -]by|creative commons attribution)( unported)?( licen[sc]e)?,?( version)?[ -]3\.0 | cc-by-3\.0 | creativecommons\.org/licenses/by/3\.0
cc-by-sa | cc, creative | (cc[ -]by[ -]sa|creative commons attribution[ -]share ?alike)([ -][1234]\.[05])? | cc-by-sa-[1234]\.[05] | creativecommons\.org/licenses/by-sa/
cc-by-nc | cc, creative | (cc[ -]by[ -]nc|creative commons attribution[ -]non ?-?commercial)([ -][1234]\.[05])? | cc-by-nc-[1234]\.[05] | creativecommons\.org/licenses/by-nc/
cc-by-nd | cc, creative | (cc[ -]by[ -]nd|creative commons attribution[ -]no ?-?deriv(ative)?s?)([ -][1234]\.[05])? | cc-by-nd-[1234]\.[05] | creativecommons\.org/licenses/by-nd/
cc-by-nc-sa | cc | cc[ -]by[ -]nc[ -]sa([ -][1234]\.[05])? | cc-by-nc-sa-[1234]\.[05] | creativecommons\.org/licenses/by-nc-sa/
cc-by-nc-nd | cc | cc[ -]by[ -]nc[ -]nd([ -][1234]\.[05])? | cc-by-nc-nd-[1234]\.[05] | creativecommons\.org/licenses/by-nc-nd/
pddl-1.0 | public domain dedication | (open data commons )?public domain dedication (and|&) licen[sc]e | pddl-1\.0 | opendatacommons\.org/licenses/pddl
odbl-1.0 | open database | open database licen[sc]e | odbl-1\.0 | opendatacommons\.org/licenses/odbl
odc-by-1.0 | open data commons | open data commons attribution licen[sc]e | odc-by-1\.0 | opendatacommons\.org/licenses/by
"""
#: Expressions of no family: label, keyword, expression, priority, confidence.
GENERAL = (
    ("gpl", "general public", r"(gnu )?general public licen[sc]e", 1, 0.7),
    ("lgpl", "lesser general", r"(gnu )?lesser general public licen[sc]e", 2, 0.8),
    ("agpl", "affero", r"(gnu )?affero general public licen[sc]e", 2, 0.8),
    ("cc-by", "cc", r"cc[ -]by", 1, 0.7),
    ("creative-commons", "creative commons", r"creative commons( licen[sc]e)?", 1, 0.6),
    ("reserved", "rights reserved", r"all rights reserved", 1, 0.6),
    ("some-rights-reserved", "rights reserved", r"some rights reserved", 1, 0.6),
    ("public-domain", "public domain", r"(released (in|into) the |in the )?public domain", 1, 0.6),
    ("copyright", "copyright", r"copyright( \(c\)| \xa9)? (19|20)[0-9]{2}", 0, 0.5),
    ("proprietary", "proprietary", r"proprietary and confidential", 1, 0.7),
    ("bsd", "bsd", r"bsd( style|-style)? licen[sc]e", 1, 0.7),
    ("permission-grant", "permission is hereby", r"permission is hereby granted,? free of charge", 1, 0.8),
)


#: Sentences of licence bodies: label | expression.
BODIES = r"""
mit | permission is hereby granted,? free of charge,? to any person obtaining a copy of (this|the) software and associated documentation
mit | the above copyright notice and this permission notice (\(including the next paragraph\) )?shall be included in all copies or substantial portions
mit | to deal in the software without restriction,? including without limitation the rights to use,? copy,? modify,? merge,? publish,? distribute,? sublicen[sc]e
as-is-warranty | the software is provided "?as[ -]is"?,? without warranty of any kind
bsd | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | neither the name of .{1,80} nor the names of (its|any) contributors may be used to endorse or promote
bsd-4-clause | all advertising materials mentioning features or use of this software must display
bsd | redistribution and use in source and binary forms,? with or without modification,? are permitted
apache-2.0 | you may not use this file except in compliance with the license
apache-2.0 | unless required by applicable law or agreed to in writing,? software distributed under the license
apache-2.0 | subject to the terms and conditions of this license,? each contributor hereby grants to you a perpetual
gpl | this program is free software[;:,]? (you can|and can) redistribute it and/or modify it
lgpl | this library is free software[;:,]? you can redistribute it and/or modify it
gpl-2.0 | either version 2 of the license,? or \(at your option\) any later version
gpl-3.0 | either version 3 of the license,? or \(at your option\) any later version
lgpl-2.1 | either version 2\.1 of the license,? or \(at your option\) any later version
gpl | distributed in the hope that it will be useful,? but without any warranty[;,]? without even the implied warranty of merchantability
gpl | you should have received a copy of the gnu general public license along with
lgpl | you should have received a copy of the gnu lesser general public license along with
agpl | you should have received a copy of the gnu affero general public license along with
agpl-3.0 | your modified version must prominently offer all users interacting with it remotely
gpl | everyone is permitted to copy and distribute verbatim copies of this license document
gfdl | permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation license
gfdl | with no invariant sections,? no front-cover texts,? and no back-cover texts
isc | permission to use,? copy,? modify,? (and|and/or) distribute this software for any purpose with or without fee is hereby granted
isc | the author disclaims all warranties with regard to this software
0bsd | permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted\.
hpnd | permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose (and )?without fee is hereby granted
postgresql | for any purpose,? without fee,? and without a written agreement is hereby granted
mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[sc]e,? v\. ?2\.0
mpl-1.1 | the contents of this file are subject to the mozilla public licen[sc]e version 1\.1
mpl | this source code form is "?incompatible with secondary licenses"?
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | the contents of this file are subject to the terms of the common development and distribution license
zlib | this software is provided '?as-is'?,? without any express or implied warranty
zlib | the origin of this software must not be misrepresented
zlib | altered source versions must be plainly marked as such
bsl-1.0 | to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy,? modify,? publish,? use,? compile,? sell,? or distribute this software
cc0-1.0 | to the extent possible under law,? .{1,80} (has|have) waived all copyright and related or neighboring rights
cc0-1.0 | affirmer hereby overtly,? fully,? permanently,? irrevocably and unconditionally waives
cc-by | copy and redistribute the material in any medium or format
cc-by | you must give appropriate credit,? provide a link to the license,? and indicate if changes were made
cc-by-sa | if you remix,? transform,? or build upon the material,? you must distribute your contributions under the same license
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | if you remix,? transform,? or build upon the material,? you may not distribute the modified material
ofl-1.1 | the fonts and derivatives,? however,? cannot be released under any other type of license
ofl-1.1 | no modified version of the font software may use the reserved font name
artistic | you may make and give away verbatim copies of the source form of the standard version of this package
artistic-2.0 | everyone is permitted to copy and distribute verbatim copies of this license document,? but changing it is not allowed
wtfpl | do what the f[a-z*]+ you want to public licen[sc]e terms and conditions for copying
beerware | as long as you retain this notice you can do whatever you want with this stuff
python-2.0 | hereby grants licensee a nonexclusive,? royalty-free,? world-wide license to reproduce,? analyze,? test,? perform and/or display publicly
openssl | this product includes software developed by the openssl project
openssl | this product includes cryptographic software written by eric young
ms-pl | each contributor grants you a non-exclusive,? worldwide,? royalty-free copyright license to reproduce its contribution
upl-1.0 | the universal permissive license,? version 1\.0 .{0,40}subject to the condition
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | the licensor hereby grants you the right to copy,? modify,? create derivative works,? redistribute,? and make non-production use
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service
ncsa | neither the names of .{1,80},? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
eupl | licensed under the eupl,? version 1\.[12] or .{1,30}as soon they will be approved by the european commission
afl-3.0 | licensed under the academic free license version 3\.0
osl-3.0 | licensed under the open software license version 3\.0
proprietary | unauthorized copying of this file,? via any medium,? is strictly prohibited
proprietary | no part of this (publication|book|work) may be reproduced,? distributed,? or transmitted
non-commercial | for personal,? non-?commercial use only
"""
#: Characters of the shortest run of an expression that gates it.
LEAST_LITERAL = 5


class Rule:
    """``gates``: sets of literals, of which any match holds all of one; ``longest`` has the longest literal of each."""

    __slots__ = ("confidence", "gates", "label", "longest", "pattern", "priority")

    def __init__(self, label, keywords, pattern, priority, confidence):
        body = pattern.replace(" ", r"\s+")
        self.label, self.priority, self.confidence = label, priority, confidence
        held = _literals(body)
        # words of an expression may be any white space apart, so they are literals of their own
        self.gates = tuple(held | frozenset(k.split()) for k in keywords.split(", "))
        self.longest = tuple(max(sorted(g), key=len) for g in self.gates)
        self.pattern = re.compile(f"(?<![{W}])(?:{body})(?![{W}])")


def _literals(body: str) -> frozenset[str]:
    """The runs of at least ``LEAST_LITERAL`` characters that every match holds."""
    from re import _constants as c
    from re import _parser

    found, run = set(), ""
    for op, arg in [*_parser.parse(body), (None, None)]:
        if op is c.LITERAL:
            run += chr(arg)
        else:
            found |= {run} if len(run) >= LEAST_LITERAL else set()
            run = ""
    return frozenset(found)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, most binding first: tag (4), grant (3), address (3), name (2), general expressions (0 to 2)."""
    made = []
    for line in FAMILIES.strip().splitlines():
        label, keywords, name, tag, address = (x.strip() for x in line.split(" | "))
        made += [
            Rule(label, "", f"spdx-license-identifier: ?(?:{tag})", 4, 1.0),
            Rule(label, keywords, f"(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:{name})", 3, 0.95),
            Rule(label, "", f"(?:https?://)?(?:www\\.)?{address}", 3, 0.9),
            Rule(label, keywords, f"(?:{name})", 2, 0.8),
        ]
    for line in BODIES.strip().splitlines():
        label, body = (x.strip() for x in line.split(" | "))
        made.append(Rule(label, "", body, 3, 0.9))
    made += [Rule(*x) for x in GENERAL]
    return tuple(sorted(made, key=lambda r: -r.priority))


@functools.cache
def prefilter():
    """Automaton over all literals, and the numbers of the rules that each literal, as the longest of a gate, brings up."""
    import ahocorasick

    by: dict[str, set[int]] = {}
    for k, r in enumerate(rules()):
        for word in r.longest:
            by.setdefault(word, set()).add(k)
    automaton = ahocorasick.Automaton()
    for word in frozenset().union(*(g for r in rules() for g in r.gates)):
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton, by


def resolve(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Detections (start, end, priority, label, confidence) that no other of at least their priority contains.

    Of equal spans the higher priority stays, then the first label. One sweep by start, so texts with many thousands of
    detections take no square of them.
    """
    out, reach = [], {}
    for x in sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if not any(end >= x[1] for p, end in reach.items() if p >= x[2]):
            out.append(x)
        reach[x[2]] = max(reach.get(x[2], 0), x[1])
    return out


def detect(text: str) -> list[tuple[int, int, int, str, float]]:
    """Detections in a text whose A-Z are lower-cased."""
    automaton, by = prefilter()
    held = {word for _, word in automaton.iter(text)}
    all_rules = rules()
    live = {k for word in held for k in by.get(word, ()) if any(g <= held for g in all_rules[k].gates)}
    return resolve([(m.start(), m.end(), r.priority, r.label, r.confidence) for k in live if (r := all_rules[k]) for m in r.pattern.finditer(text)])


_BASE = [(label, re.compile(f"(?<![{W}])" + f"[^{W}]+".join(phrase) + f"(?![{W}])")) for label, phrase in BASE]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(f"[{W}]+")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))


def _scan(id_col: str, text_col: str):
    def run(batches):
        for batch in batches:
            ids = batch.column(id_col)
            for i, j, raw, offsets in blocks(batch.column(text_col)):
                _, at = words(raw, offsets, PLAIN)
                lowered = raw.tobytes().translate(_LOWER)
                cols: dict[str, list] = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = lowered[a:b].decode("utf-8", "replace")
                    found = detect(text)
                    places, base = [], set()
                    for (label, phrase), (_, pattern) in zip(BASE, _BASE, strict=True):
                        if phrase[0] in text:
                            own = [m.start() for m in pattern.finditer(text)]
                            places += own
                            base |= {label} if own else set()
                    labels = base | {x[3] for x in found}
                    cols["n_base"].append(len(places))
                    for name, pick in (("first_word", min), ("last_word", max)):
                        cols[name].append(sum(1 for _ in _WORD.finditer(text, 0, pick(places))) if places else None)
                    cols["base_labels"].append(",".join(sorted(base)))
                    cols["labels"].append(",".join(sorted(labels)))
                    cols["score"].append(max([0.7 * bool(base), *(x[4] for x in found)]))
                    cols["detections"].append([{"start": x[0], "end": x[1], "label": x[3]} for x in found])
                types = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64(), "detections": _SPANS}
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at)), *(pa.array(v, types.get(k, pa.string())) for k, v in cols.items())], names=["id", "n_words", *cols])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``detections``.

    ``detections`` are the surviving spans in code points of the whole text; ``score`` is the best confidence of one of
    them, 0 without any. A null or empty text has no words and no labels (empty strings). Null and repeated ids pass
    through, row by row; other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = "array<struct<start:long,end:long,label:string>>"
    return base.mapInArrow(_scan("id", "text"), f"id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections {spans}")
