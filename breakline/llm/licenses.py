r"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions over the words joined by one space.
A rule runs only where one of its keywords occurs, beginnings of words that each of its matches has; a document without
any keyword of any rule and without a base phrase is done after these substring searches.
Detections are resolved in order of priority: one that lies inside a detection of higher (or equal, earlier) priority
is suppressed, found by bisection among the intervals taken, so long texts cost no more a byte than short ones. The base phrases are counted apart from that and their labels always stay. One pass, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    weight: float


#: Hand-written signatures: priority, weight, then lines of "label | keyword|keyword | expression over words".
FULL_TEXT = 90, 0.95
GRANT = 70, 0.8
NAMED = 50, 0.7
TAG = 60, 0.9
HINT = 20, 0.3
SIGNATURES = {
    FULL_TEXT: r"""
mit | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0 | permission | permission is hereby granted free of charge to any person obtaining a copy .{0,400}to do so the software is provided as is
isc | permission | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
0bsd | permission | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | redistribution | redistribution and use in source and binary forms .{0,900}neither the name of
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd-3-clause | endorse | may be used to endorse or promote products derived from this software without
apache-2.0 | apache | licensed under the apache license version 2 0 the license
apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | gnu | you should have received a copy of the gnu general public license
gpl | gnu | gnu general public license for more details
lgpl | lesser | you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | lesser | you should have received a copy of the gnu lesser general public license
lgpl | library | you should have received a copy of the gnu library general public license
agpl | affero | you should have received a copy of the gnu affero general public license
gpl-preamble | copyleft | the gnu general public license is a free copyleft license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1.0 | distribution | subject to the terms of the common development and distribution license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
cc0-1.0 | waiving | has dedicated the work to the public domain by waiving all of his or her rights
wtfpl | fuck | you just do what the fuck you want to
zlib | misrepresented | the origin of this software must not be misrepresented
zlib | plainly | altered source versions must be plainly marked as such
bsl-1.0 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
artistic-2.0 | artistic | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed .{0,400}artistic
python-2.0 | psf | psf grants licensee a nonexclusive royalty free world wide license
openssl | openssl | this product includes software developed by the openssl project
php-3.01 | php | this product includes php software freely available
postgresql | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
unicode-dfs | unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ofl-1.1 | font | this font software is licensed under the sil open font license
cc-by-4.0 | creative | licensed under a creative commons attribution 4 0 international
cc-by-sa-4.0 | creative | licensed under a creative commons attribution share ?alike 4 0 international
json | evil | the software shall be used for good not evil
beerware | beer | you can buy me a beer in return
curl | curl | permission to use copy modify and distribute this software for any purpose with or without fee .{0,200}curl
ncsa | illinois | university of illinois .{0,40}open source license
w3c | w3c | w3c software notice and license
vim | vim | vim license .{0,200}charityware
proprietary | proprietary | (?:this|the) (?:software|document|material) is (?:confidential and )?proprietary
proprietary | unauthori | unauthori[sz]ed (?:copying|use|distribution) of this file
all-rights-reserved | reserved | all rights reserved
warranty-disclaimer | warranty | is provided as is without warranty of any kind
warranty-disclaimer | warranties | distributed on an as is basis without warranties or conditions of any kind
""",
    GRANT: r"""
llama-community | llama | licensed under the llama [23](?: [1-9])? community licen[cs]e
openrail | openrail | (?:licensed|released) under (?:the |an )?(?:creativeml |bigscience )?openrail(?: m)?
hippocratic | hippocratic | licensed under the hippocratic licen[cs]e
cc-by-nc | non commercial|noncommercial | may not be used for (?:any )?(?:non ?commercial or )?commercial purposes without .{0,40}non ?commercial
non-commercial | commercial|noncommercial | for non ?commercial (?:use|purposes) only
research-only | research | for (?:academic and )?research (?:use|purposes) only
no-redistribution | redistribut | (?:may|must|can) not (?:be )?redistribut(?:e|ed) without (?:prior )?(?:written )?permission
by-permission | permission | (?:used|reprinted|reproduced) (?:with|by) permission(?: of the (?:author|publisher))?
no-warranty | warranty | there is no warranty for the program
no-derivatives | derivative | you may not create derivative works
attribution-required | attribution | attribution (?:is )?required
share-alike | share | share (?:your )?(?:adaptations|contributions) under the same licen[cs]e
open-access | access | this is an open access article distributed under the terms
crown-copyright | crown | crown copyright(?: and database rights?)?
open-government | government | contains public sector information licensed under the open government licen[cs]e
osm-odbl | openstreetmap | openstreetmap contributors
wikipedia-text | wikipedia | text (?:from|of) wikipedia is available under
gutenberg | gutenberg | project gutenberg licen[cs]e
eula | user | end user licen[cs]e agreement
mit | mit | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit(?: license| licence)?
apache | apache | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license| licence)?
gpl | gpl | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
lgpl | lgpl | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
agpl | agpl | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
bsd | bsd | (?:released|licensed|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the |a )?bsd(?: style)?(?: license| licence)?
mpl | mozilla | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e
epl | eclipse | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?eclipse public licen[cs]e
creative-commons | creative | (?:released|licensed|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the |a )?creative commons
public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | domain | this (?:work|file|code|software|text) is in the public domain
dual | dual | dual licensed under
see-license | licen | see (?:the )?(?:accompanying )?licen[cs]e (?:file )?for (?:more )?(?:details|information)
use-is-subject | governed | use of this (?:source code|software|file) is governed by an? .{0,40}licen[cs]e
permitted-copying | verbatim | verbatim copying and distribution of this entire (?:article|document) (?:is|are) permitted
""",
    NAMED: r"""
mit | mit | (?:the )?mit licen[cs]e
mit | expat | (?:the )?expat licen[cs]e
mit-cmu | carnegie | carnegie mellon .{0,40}licen[cs]e
x11 | x11 | x11 licen[cs]e
isc | isc | (?:the )?isc licen[cs]e
gpl | gnu | gnu general public licen[cs]e
gpl | gnu | gnu gpl
lgpl | lesser | gnu lesser general public licen[cs]e
lgpl | library | gnu library general public licen[cs]e
agpl | affero | (?:gnu )?affero general public licen[cs]e
gfdl | documentation | gnu free documentation licen[cs]e
apache | apache | apache(?: software)? licen[cs]e
bsd | bsd | bsd(?: style| type)? licen[cs]e
bsd-2-clause | freebsd | freebsd licen[cs]e
bsd-2-clause | simplified | simplified bsd
bsd-3-clause | bsd | (?:new|revised|modified) bsd
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
cpl | common | common public licen[cs]e
cddl | distribution | common development and distribution licen[cs]e
eupl | european | european union public licen[cs]e
osl | open | open software licen[cs]e
afl | academic | academic free licen[cs]e
artistic | artistic | artistic licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
bsl | boost | boost software licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
ofl | sil | sil open font licen[cs]e
odbl | database | open (?:data commons open )?database licen[cs]e
pddl | dedication | public domain dedication and licen[cs]e
unlicense | unlicense | (?:the )?unlicense
cecill | cecill | cecill(?: [abc])?(?: licen[cs]e)?
qpl | public | q public licen[cs]e
ruby | ruby | ruby licen[cs]e
psf | python | python software foundation licen[cs]e
php | php | php licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
sleepycat | sleepycat | sleepycat licen[cs]e
wtfpl | public | do what the fuck you want to public licen[cs]e
business-source | business | business source licen[cs]e
elastic | elastic | elastic licen[cs]e
sspl | server | server side public licen[cs]e
commons-clause | commons | commons clause
cc-by | cc | cc by
cc-by | attribution | creative commons attribution(?: licen[cs]e)?
cc-by-sa | sharealike|share alike | creative commons attribution share ?alike
cc-by-nc | noncommercial|non commercial | creative commons attribution non ?commercial
cc-by-nd | noderiv|no deriv | creative commons attribution no ?deriv(?:ative)?s?
cc0 | cc0 | cc0(?: 1 0)?(?: universal)?
creative-commons | creative | creative commons
public-domain | domain | public domain
copyleft | copyleft | copyleft
apsl | apple | apple public source licen[cs]e
amazon-software | amazon | amazon software licen[cs]e
adobe | adobe | adobe (?:systems )?(?:source code|glyph list|postscript afm) licen[cs]e
aladdin | aladdin | aladdin free public licen[cs]e
anti-996 | 996 | anti 996 licen[cs]e
aml | apple | apple mit licen[cs]e
attribution-assurance | assurance | attribution assurance licen[cs]e
bittorrent | bittorrent | bittorrent open source licen[cs]e
blueoak | oak | blue oak model licen[cs]e
borceux | borceux | borceux licen[cs]e
bzip2 | bzip2 | bzip2(?: and libbzip2)? licen[cs]e
catosl | computer | computer associates trusted open source licen[cs]e
cdla-permissive | data | community data licen[cs]e agreement permissive
cdla-sharing | data | community data licen[cs]e agreement sharing
cern-ohl | cern | cern open hardware licen[cs]e
clear-bsd | clear | clear bsd(?: licen[cs]e)?
cnri | cnri | cnri (?:python )?(?:open source )?licen[cs]e
condor | condor | condor public licen[cs]e
confluent | confluent | confluent community licen[cs]e
cpal | common | common public attribution licen[cs]e
cua-opl | cua | cua office public licen[cs]e
d-fsl | deutsche | deutsche freie software lizenz
dl-de | datenlizenz | datenlizenz deutschland
ecl | educational | educational community licen[cs]e
efl | eiffel | eiffel forum licen[cs]e
entessa | entessa | entessa public licen[cs]e
erlang | erlang | erlang public licen[cs]e
etalab | etalab | etalab (?:open )?licen[cs]e
eudatagrid | datagrid | eu datagrid software licen[cs]e
fair | fair | fair licen[cs]e
fair-source | fair|functional | (?:fair|functional) source licen[cs]e
frameworx | frameworx | frameworx open licen[cs]e
freetype | freetype | freetype (?:project )?licen[cs]e
gemma | gemma | gemma terms of use
giftware | giftware | giftware licen[cs]e
gsoap | gsoap | gsoap public licen[cs]e
hpnd | historical | historical permission notice and disclaimer
ibm-pl | ibm | ibm public licen[cs]e
icu | icu | icu licen[cs]e
ijg | jpeg | independent jpeg group(?: licen[cs]e)?
imagemagick | imagemagick | imagemagick licen[cs]e
info-zip | info | info zip licen[cs]e
intel | intel | intel open source licen[cs]e
interbase | interbase | interbase public licen[cs]e
ipa-font | ipa | ipa font licen[cs]e
jasper | jasper | jasper licen[cs]e
lucent | lucent | lucent public licen[cs]e
libpng | libpng | libpng licen[cs]e
libtiff | libtiff | libtiff licen[cs]e
licence-ouverte | ouverte | licence ouverte
miros | miros | miros licen[cs]e
motosoto | motosoto | motosoto open source licen[cs]e
mulan | mulan | mulan (?:permissive software|psl|public) licen[cs]e
multics | multics | multics licen[cs]e
nasa | nasa | nasa open source agreement
naumen | naumen | naumen public licen[cs]e
ncsa | ncsa | ncsa (?:open source )?licen[cs]e
nethack | nethack | nethack general public licen[cs]e
npl | netscape | netscape public licen[cs]e
nokia | nokia | nokia open source licen[cs]e
nlod | norwegian | norwegian licen[cs]e for open government data
nposl | profit | non profit open software licen[cs]e
ntp | ntp | ntp licen[cs]e
oclc | oclc | oclc research public licen[cs]e
odc-by | commons | open data commons attribution licen[cs]e
ogl | government | open government licen[cs]e
oldap | openldap | openldap public licen[cs]e
open-content | content | open content licen[cs]e
open-publication | publication | open publication licen[cs]e
osgi | osgi | osgi specification licen[cs]e
parity | parity | parity public licen[cs]e
polyform-nc | polyform | polyform non ?commercial licen[cs]e
polyform-sb | polyform | polyform small business licen[cs]e
prosperity | prosperity | prosperity public licen[cs]e
qhull | qhull | qhull licen[cs]e
redis-sal | redis | redis source available licen[cs]e
rpl | reciprocal | reciprocal public licen[cs]e
rpsl | realnetworks | realnetworks public source licen[cs]e
ricoh | ricoh | ricoh source code public licen[cs]e
sgi-b | sgi | sgi free software licen[cs]e b
simpl | simple | simple public licen[cs]e
sissl | industry | sun industry standards source licen[cs]e
spl | sun | sun public licen[cs]e
sugarcrm | sugarcrm | sugarcrm public licen[cs]e
tcl | tcl | tcl(?: tk)? licen[cs]e
timescale | timescale | timescale licen[cs]e
truecrypt | truecrypt | truecrypt licen[cs]e
upl | universal | universal permissive licen[cs]e
vovida | vovida | vovida software licen[cs]e
watcom | watcom | sybase open watcom public licen[cs]e
wxwindows | wxwindows | wxwindows (?:library )?licen[cs]e
xfree86 | xfree86 | xfree86 licen[cs]e
yahoo-pl | yahoo | yahoo public licen[cs]e
zend | zend | zend (?:engine )?licen[cs]e
zimbra | zimbra | zimbra public licen[cs]e
""",
    HINT: r"""
license-mention | licen | licen[cs]e
licensed-mention | licen | licen[cs]ed
copyright | copyright | copyright (?:c )?(?:19|20)\d\d
copyright | copyright | copyright
all-rights-reserved | rights | all rights reserved
terms | terms | terms (?:of|and) (?:use|service|conditions)
trademark | trademark | registered trademarks?
""",
}
#: Families whose names come with versions: rules for "<name> [version] x[.y]" and identifiers in tags are made from them.
FAMILIES = {
    "gpl": (r"(?:gnu )?(?:gpl|general public licen[cs]e)", "gpl|general", ("1.0", "2.0", "3.0")),
    "lgpl": (r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", "lgpl|lesser|library", ("2.0", "2.1", "3.0")),
    "agpl": (r"(?:gnu )?(?:agpl|affero general public licen[cs]e)", "agpl|affero", ("1.0", "3.0")),
    "gfdl": (r"(?:gnu )?(?:gfdl|free documentation licen[cs]e)", "gfdl|documentation", ("1.1", "1.2", "1.3")),
    "apache": (r"apache(?: software)?(?: licen[cs]e)?", "apache", ("1.0", "1.1", "2.0")),
    "mpl": (r"(?:mpl|mozilla public licen[cs]e)", "mpl|mozilla", ("1.0", "1.1", "2.0")),
    "epl": (r"(?:epl|eclipse public licen[cs]e)", "epl|eclipse", ("1.0", "2.0")),
    "eupl": (r"(?:eupl|european union public licen[cs]e)", "eupl|european", ("1.0", "1.1", "1.2")),
    "cddl": (r"(?:cddl|common development and distribution licen[cs]e)", "cddl|common", ("1.0", "1.1")),
    "osl": (r"(?:osl|open software licen[cs]e)", "osl|open", ("1.0", "2.0", "2.1", "3.0")),
    "afl": (r"(?:afl|academic free licen[cs]e)", "afl|academic", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "artistic": (r"artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    "cecill": (r"cecill", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    "zpl": (r"(?:zpl|zope public licen[cs]e)", "zpl|zope", ("1.1", "2.0", "2.1")),
    "lppl": (r"(?:lppl|latex project public licen[cs]e)", "lppl|latex", ("1.0", "1.1", "1.2", "1.3")),
    "php": (r"php licen[cs]e", "php", ("3.0", "3.01")),
    "cc-by": (r"(?:cc by|creative commons attribution)", "cc|creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "cc-by-sa": (r"(?:cc by sa|creative commons attribution share ?alike)", "cc|creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "cc-by-nc": (r"(?:cc by nc|creative commons attribution non ?commercial)", "cc|creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "cc-by-nd": (r"(?:cc by nd|creative commons attribution no ?derivs?)", "cc|creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "cc-by-nc-sa": (r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc|creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "cc-by-nc-nd": (r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivs?)", "cc|creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
}
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def rules() -> list[Rule]:
    """All rules, best first: signatures as listed, then versioned names and tags of every family."""
    out = []
    for (priority, weight), lines in SIGNATURES.items():
        for line in lines.strip().splitlines():
            label, keyword, expression = (x.strip() for x in line.split(" | "))
            out.append((label, priority, keyword, expression, weight))
    for family, (name, keyword, versions) in FAMILIES.items():
        for v in versions:
            number = v.replace(".0", "(?: 0)?").replace(".", " ")
            out.append((f"{family}-{v}", NAMED[0] + 5, keyword, rf"{name} (?:v|version )?{number}(?: only| or (?:any )?later(?: version)?)?", NAMED[1]))
            out.append((f"{family}-{v}", TAG[0], "spdx", rf"spdx license identifier {family.replace('-', ' ')} {v.replace('.', ' ')}", TAG[1]))
    out.sort(key=lambda r: -r[1])
    return [Rule(label, p, tuple(f" {x}".encode() for x in k.split("|")), re.compile(rb" (?:" + e.encode() + rb")(?= )"), w) for label, p, k, e, w in out]


class Intervals:
    """Intervals none of which lies inside another, in order: their starts and their ends both ascend."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """False if [a, b) lies inside a known interval; else it is known, and stands for those inside it."""
        at = bisect_right(self.starts, a)
        if at and self.ends[at - 1] >= b:
            return False
        low, high = bisect_left(self.starts, a), bisect_right(self.ends, b)
        self.starts[low:high], self.ends[low:high] = [a], [b]
        return True


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.base = [(b" " + p.encode() + b" ", label) for p, label in BASE.items()]
        self.gates = sorted({k for r in self.rules for k in r.keywords} | {p for p, _ in self.base})

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.translate(WORDS).split()
        joined = b" " + b" ".join(words) + b" "
        gates = {g for g in self.gates if g in joined}
        if not gates:
            return len(words), 0, None, None, "", "", 0.0
        places, base = [], set()
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = joined.find(phrase, at + 1)
        best: dict[str, Rule] = {}
        taken = Intervals()
        for rule in self.rules:
            if not gates.isdisjoint(rule.keywords):
                for m in rule.pattern.finditer(joined):
                    if taken.add(m.start() + 1, m.end()):
                        best.setdefault(rule.label, rule)
        missing = 1.0
        for r in best.values():
            missing *= 1 - r.weight
        for _ in base:
            missing *= 0.3
        index = lambda at: joined.count(b" ", 0, at)  # noqa: E731  words before a place
        return len(words), len(places), index(min(places)) if places else None, index(max(places)) if places else None, ",".join(sorted(base)), ",".join(sorted(base | set(best))), 1 - missing


_scanner: list[Scanner] = []


def _scanned(batches):
    if not _scanner:
        _scanner.append(Scanner())
    own = _scanner[0]
    for batch in batches:
        found = list(zip(*(own.scan(t.as_py() or b"") for t in batch.column("text")), strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text has no words. Places of base phrases may overlap. Labels are distinct, sorted and comma-joined, an
    empty string where there are none; ``score`` grows with the number and weight of distinct labels (0 without any).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
