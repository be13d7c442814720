"""The signature rules of the licence scan.

Patterns are matched on words: lower-case letters and digits, one space between. ``4.0`` reads
``4 0``. A rule is tried only on texts that hold its keyword. Hand-written phrases come first;
families that differ by kind and version are written once and spelled out for each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

# Priorities, the strongest first, and how sure a detection of each is.
TAG, NOTICE, NAMED, NAME, MENTION = range(5)
CONFIDENCE = (1.0, 0.95, 0.85, 0.7, 0.4)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


# The phrases that are always reported, whatever lies around them.
BASE = (
    Rule("cc-by", NAME, "cc by", "cc by", True),
    Rule("gpl", NAME, "general public license", "general public license", True),
    Rule("reserved", MENTION, "all rights reserved", "all rights reserved", True),
)

# label | priority | keyword | pattern
_PHRASES = r"""
mit | notice | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | notice | shall be included | the above copyright notice and this permission notice shall be included in all copies
mit | named | mit licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[cs]e
mit | name | mit licen | (?:the )?mit licen[cs]e
mit | name | expat | expat licen[cs]e
mit-0 | name | mit no attribution | mit no attribution(?: licen[cs]e)?
x11 | name | x11 licen | (?:mit )?x11 licen[cs]e
isc | notice | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | name | isc licen | isc licen[cs]e
0bsd | name | zero clause bsd | zero clause bsd(?: licen[cs]e)?
bsd | notice | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | notice | endorse or promote | neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products
bsd-3-clause | named | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-2-clause | named | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-4-clause | named | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?
bsd-4-clause | notice | advertising materials | all advertising materials mentioning features or use of this software must display
bsd | name | bsd licen | bsd licen[cs]e
bsd | name | bsd style | bsd style licen[cs]e
apache-2.0 | notice | apache | licensed under the apache licen[cs]e version 2 0
apache-2.0 | tag | apache org | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | notice | without warranties or conditions | distributed on an as is basis without warranties or conditions of any kind
apache | name | apache | apache (?:software )?licen[cs]e
gpl | notice | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later | notice | either version 2 | either version 2 of the license or at your option any later version
gpl-3.0-or-later | notice | either version 3 | either version 3 of the license or at your option any later version
gpl | notice | without any warranty | (?:it|program) (?:is distributed|will be useful)(?: [^ ]+){0,12} without any warranty without even the implied warranty
gpl | name | gpl | (?:gnu )?gpl(?:ed)?
lgpl | name | lgpl | (?:gnu )?lgpl
lgpl | name | general public licen | gnu (?:lesser|library) general public licen[cs]e
agpl | name | agpl | (?:gnu )?agpl
agpl | name | affero | (?:gnu )?affero general public licen[cs]e
gfdl | name | free documentation | (?:gnu )?free documentation licen[cs]e
gpl | name | general public licen | gnu general public licen[cs]e
gpl-classpath-exception | named | classpath exception | (?:with (?:the )?)?classpath exception
gcc-exception | named | gcc runtime library exception | gcc runtime library exception
mpl | notice | mozilla public | this source code form is subject to the terms of the mozilla public license
mpl-2.0 | tag | mozilla org | mozilla org mpl 2 0
mpl | name | mozilla public | mozilla public licen[cs]e
epl | name | eclipse public | eclipse public licen[cs]e
edl | name | eclipse distribution | eclipse distribution licen[cs]e
cddl | name | common development | common development and distribution licen[cs]e
cpl | name | common public licen | common public licen[cs]e
ipl | name | ibm public | ibm public licen[cs]e
eupl | name | european union public | european union public licen[cs]e
artistic | name | artistic licen | artistic licen[cs]e
perl | named | same terms as perl | (?:under )?the same terms as perl(?: itself)?
bsl-1.0 | notice | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy
bsl-1.0 | name | boost software | boost software licen[cs]e
zlib | notice | provided as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | notice | origin of this software | the origin of this software must not be misrepresented
zlib | name | zlib | zlib(?: libpng)? licen[cs]e
libpng | name | libpng licen | libpng licen[cs]e
unlicense | notice | unencumbered | this is free and unencumbered software released into the public domain
unlicense | name | unlicense | the unlicense
wtfpl | name | wtfpl | wtfpl
wtfpl | name | what the fuck | do what the fuck you want to public licen[cs]e
cc0-1.0 | tag | creativecommons org | creativecommons org publicdomain zero(?: 1 0)?
cc0-1.0 | name | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
public-domain-mark | tag | creativecommons org | creativecommons org publicdomain mark(?: 1 0)?
public-domain | named | public domain | (?:(?:released|dedicated|placed) (?:in|in to|into|to) )?the public domain
public-domain | mention | public domain | public domain
cc | mention | creative commons | creative commons(?: licen[cs]es?)?
cc-sampling | name | sampling plus | (?:creative commons )?sampling plus(?: 1 0)?
odbl-1.0 | name | open database | open database licen[cs]e
odc-by-1.0 | name | open data commons | open data commons attribution licen[cs]e
pddl-1.0 | name | public domain dedication | (?:odc )?public domain dedication and licen[cs]e
ogl-uk | name | open government | open government licen[cs]e
ogl-uk | tag | nationalarchives | nationalarchives gov uk doc open government licence
etalab | name | licence ouverte | licence ouverte(?: open licence)?
dl-de-by | name | datenlizenz deutschland | datenlizenz deutschland namensnennung
dl-de-zero | named | datenlizenz deutschland | datenlizenz deutschland zero
cdla-permissive | name | community data | community data licen[cs]e agreement permissive
cdla-sharing | name | community data | community data licen[cs]e agreement sharing
ofl | name | open font | (?:sil )?open font licen[cs]e
ms-pl | name | microsoft public | microsoft public licen[cs]e
ms-rl | name | microsoft reciprocal | microsoft reciprocal licen[cs]e
psf | name | python software foundation | python software foundation licen[cs]e
php | name | php licen | php licen[cs]e
ruby | name | ruby licen | ruby licen[cs]e
openssl | name | openssl licen | openssl licen[cs]e
ntp | name | ntp licen | ntp licen[cs]e
postgresql | name | postgresql licen | postgresql licen[cs]e
ncsa | name | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e
w3c | name | w3c | w3c software (?:notice and )?(?:and document )?licen[cs]e
icu | name | icu licen | icu licen[cs]e
unicode | name | unicode licen | unicode licen[cs]e
curl | name | curl licen | curl licen[cs]e
ijg | named | independent jpeg | independent jpeg group
jpeg | mention | jpeg group | jpeg group
beerware | name | beerware | (?:the )?beerware licen[cs]e
beerware | named | beer | buy me a beer in return
json | notice | good not evil | the software shall be used for good not evil
vim | name | vim licen | vim licen[cs]e
tcl | name | tcl | tcl tk licen[cs]e
afl | name | academic free | academic free licen[cs]e
osl | name | open software licen | open software licen[cs]e
qpl | name | q public | q public licen[cs]e
sleepycat | name | sleepycat | sleepycat licen[cs]e
cecill | name | cecill | cecill(?: [abc])?(?: licen[cs]e)?
mulan-psl | name | mulan | mulan (?:psl|permissive software licen[cs]e)
bluoak | name | blue oak | blue oak model licen[cs]e
sspl-1.0 | name | server side public | server side public licen[cs]e
busl-1.1 | name | business source | business source licen[cs]e
elastic-2.0 | name | elastic licen | elastic licen[cs]e
commons-clause | name | commons clause | commons clause
polyform | name | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e
openrail | name | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?
openrail | name | open rail | (?:bigscience |creativeml )?open rail(?: m)?(?: licen[cs]e)?
llama | name | llama | llama(?: [0-9]+){0,2} community licen[cs]e
gemma | name | gemma terms | gemma terms of use
proprietary | named | proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | mention | proprietary licen | proprietary licen[cs]e
proprietary | notice | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
non-commercial | mention | non commercial | (?:for )?non commercial (?:use|purposes?)(?: only)?
non-commercial | mention | noncommercial | (?:for )?noncommercial (?:use|purposes?)(?: only)?
personal-use | mention | personal use | (?:for )?personal use only
research-only | mention | research | (?:for )?research (?:use|purposes?) only
research-only | mention | academic | (?:for )?academic (?:use|purposes?) only
reserved | notice | rights reserved | all rights reserved(?: worldwide)? no part of this(?: [^ ]+){1,10} may be reproduced
reserved | mention | some rights reserved | some rights reserved
reserved | mention | droits | tous droits réservés
reserved | mention | alle rechte vorbehalten | alle rechte vorbehalten
reserved | mention | todos los derechos | todos los derechos reservados
copyright | mention | copyright | copyright(?: c| ©)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | mention | © | © (?:19|20)[0-9]{2}
copyright | mention | copyrighted | copyrighted (?:material|work|by)
as-is | mention | as is | provided (?:on an )?as is(?: basis)?(?: without warrant(?:y|ies))?
licensed | mention | licensed under | licensed under(?: the)?(?: [^ ]+){1,6} licen[cs]e(?: (?:v|version))?(?: [0-9]+){0,2}
licensed | mention | terms of the licen | (?:under|subject to) the terms of the licen[cs]e
licensed | mention | license file | see (?:the )?(?:accompanying )?license file
licensed | mention | lizenz | lizenziert unter
licensed | mention | licence | sous licence
licensed | mention | licencia | (?:bajo|con) (?:la )?licencia
"""

# label | name, as a pattern | short name, as a pattern | versions
_VERSIONED = r"""
apache | apache (?:software )?licen[cs]e | apache | 1.0 1.1 2.0
mpl | mozilla public licen[cs]e | mpl | 1.0 1.1 2.0
epl | eclipse public licen[cs]e | epl | 1.0 2.0
cddl | common development and distribution licen[cs]e | cddl | 1.0 1.1
eupl | european union public licen[cs]e | eupl | 1.0 1.1 1.2
artistic | artistic licen[cs]e | artistic | 1.0 2.0
afl | academic free licen[cs]e | afl | 1.2 2.0 2.1 3.0
osl | open software licen[cs]e | osl | 1.0 2.0 2.1 3.0
ofl | open font licen[cs]e | ofl | 1.0 1.1
lppl | latex project public licen[cs]e | lppl | 1.0 1.1 1.2 1.3
cecill | cecill licen[cs]e | cecill | 1.0 2.0 2.1
php | php licen[cs]e | php licen[cs]e | 3.0 3.01
psf | python software foundation licen[cs]e | psf | 2.0
ogl-uk | open government licen[cs]e | ogl | 1.0 2.0 3.0
zpl | zope public licen[cs]e | zpl | 1.1 2.0 2.1
"""

_TAGGED = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 "
    "BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 "
    "CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 "
    "CDDL-1.1 CECILL-2.1 CPL-1.0 curl ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 "
    "GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ICU ISC "
    "LGPL-2.0-only LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only "
    "LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA "
    "ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby "
    "Sleepycat SSPL-1.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()

_PARTS = {
    "by": "attribution",
    "nc": "non ?commercial",
    "sa": "share ?alike",
    "nd": "no ?deriv(?:ative)?s?(?: works)?",
}
_CC = ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("", "1.0", "2.0", "2.5", "3.0", "4.0")

# Kind, the word that tells it in the long name, versions.
_GNU = (
    ("gpl", "", ("1.0", "2.0", "3.0")),
    ("lgpl", "(?:lesser|library) ", ("2.0", "2.1", "3.0")),
    ("agpl", "affero ", ("1.0", "3.0")),
)


def _spoken(version: str) -> str:
    """A version as words: ``2.0`` may also be written 2."""
    whole, _, part = version.partition(".")
    return f"(?:{whole}(?: 0)?)" if part == "0" else f"{whole} {part}"


def _phrases() -> list[Rule]:
    priorities = dict(tag=TAG, notice=NOTICE, named=NAMED, name=NAME, mention=MENTION)
    rules = []
    for line in _PHRASES.strip().splitlines():
        label, priority, keyword, pattern = (part.strip() for part in line.split(" | "))
        rules.append(Rule(label, priorities[priority], keyword, pattern))
    return rules


def _versioned() -> list[Rule]:
    rules = []
    for line in _VERSIONED.strip().splitlines():
        label, name, short, versions = (part.strip() for part in line.split(" | "))
        for version, written in product(versions.split(), dict.fromkeys((name, short))):
            number = f"(?: (?:v|version))? ?v?{_spoken(version)}"
            keyword = re.split(r"[(\[?]", written)[0].strip()
            rules.append(Rule(f"{label}-{version}", NAMED, keyword, written + number))
    return rules


def _tagged() -> list[Rule]:
    rules = []
    for name in _TAGGED:
        words = " ".join(re.findall("[a-z0-9]+", name.lower()))
        pattern = f"spdx license identifier {words}"
        rules.append(Rule(name.lower(), TAG, "spdx license identifier", pattern))
    return rules


def _creative_commons() -> list[Rule]:
    rules = []
    for kind, version in product(_CC, _CC_VERSIONS):
        label = f"cc-{kind}" + (f"-{version}" if version else "")
        number = f" (?:v|version )?{_spoken(version)}" if version else ""
        words = kind.replace("-", " ")
        spelled = " ".join(_PARTS[part] for part in kind.split("-"))
        priority = NAMED if version else NAME
        rules += [
            Rule(label, priority, f"cc {words}", f"cc {words}{number}"),
            Rule(
                label, priority, "creative commons attribution",
                f"creative commons {spelled}{number}(?: (?:international|unported|generic))?"
                f"(?: licen[cs]e)?",
            ),
            Rule(label, TAG, "creativecommons org", f"creativecommons org licenses {words}{number}"),
        ]
    return rules


def _gnu() -> list[Rule]:
    rules = []
    for (kind, which, versions), later in product(_GNU, (False, True)):
        for version in versions:
            label = f"{kind}-{version}" + ("-or-later" if later else "")
            number = f"(?: (?:v|version))? ?v?{_spoken(version)}"
            if later:
                number += "(?: or (?:any )?later(?: version)?| or at your option any later version)"
            long = f"(?:gnu )?{which}general public licen[cs]e"
            rules.append(Rule(label, NAMED, "general public licen", long + number))
            rules.append(Rule(label, NAMED, kind, f"(?:gnu )?{kind}{number}"))
            if not later:
                link = f"gnu org licenses (?:old licenses )?{kind} {_spoken(version)}"
                rules.append(Rule(label, TAG, "gnu org licenses", link))
    return rules


SIGNATURES: tuple[Rule, ...] = (
    *BASE, *_phrases(), *_versioned(), *_tagged(), *_creative_commons(), *_gnu(),
)
