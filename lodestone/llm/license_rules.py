"""Signatures of licence statements: ordered, hand-written regular expressions.

Rules match a normalised text: words (runs of letters and digits, lower-cased) separated by single spaces, so version 2.0
reads "2 0" and GPL-3.0 reads "gpl 3 0". A rule is tried only on texts that hold its keyword. Tiers rank rules: a detection
is suppressed when it lies inside one of its own or a lower-numbered tier.

  tier 0  a full name with its version, or a grant's own wording
  tier 1  a full name
  tier 2  an identifier or abbreviation
  tier 3  a statement about rights that names no licence
"""

from __future__ import annotations

#: Score of a detection by tier.
CONFIDENCE = (1.0, 0.9, 0.7, 0.4)

#: label | tier | keyword | expression, a rule in each line.
_WRITTEN = r"""
mit | 0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0 | permission notice shall be included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 0 | mit license | (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mit license
mit | 1 | mit license | (?:the )?mit license
mit | 1 | mit licence | (?:the )?mit licence
mit | 1 | expat license | expat license
mit | 2 | spdx license identifier mit | spdx license identifier mit
mit-0 | 0 | mit no attribution | mit no attribution(?: license)?
mit-0 | 2 | spdx license identifier mit 0 | spdx license identifier mit 0
x11 | 1 | x11 license | (?:mit )?x11 license
isc | 0 | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 1 | isc license | (?:the )?isc license
isc | 2 | spdx license identifier isc | spdx license identifier isc
0bsd | 1 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
0bsd | 2 | spdx license identifier 0bsd | spdx license identifier 0bsd
bsd | 0 | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
bsd | 1 | bsd license | (?:the )?(?:original |modified |new |revised |simplified )?bsd license
bsd | 1 | bsd style license | (?:a )?bsd style license
bsd-2-clause | 0 | 2 clause bsd | (?:the )?2 clause bsd license
bsd-2-clause | 0 | two clause bsd | (?:the )?two clause bsd license
bsd-2-clause | 1 | simplified bsd license | (?:the )?simplified bsd license
bsd-2-clause | 2 | bsd 2 clause | bsd 2 clause
bsd-3-clause | 0 | 3 clause bsd | (?:the )?3 clause bsd license
bsd-3-clause | 0 | three clause bsd | (?:the )?three clause bsd license
bsd-3-clause | 0 | endorse or promote products derived from this software without specific prior written permission | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 1 | new bsd license | (?:the )?new bsd license
bsd-3-clause | 1 | revised bsd license | (?:the )?revised bsd license
bsd-3-clause | 2 | bsd 3 clause | bsd 3 clause
bsd-4-clause | 0 | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4-clause | 1 | original bsd license | (?:the )?original bsd license
bsd-4-clause | 2 | bsd 4 clause | bsd 4 clause
apache | 0 | licensed under the apache license | licensed under the apache license version 2 0(?: the license)?
apache | 0 | apache license version 2 0 | (?:the )?apache license version 2 0
apache | 0 | apache software license version 1 1 | (?:the )?apache software license version 1 1
apache | 1 | apache license | (?:the )?apache license
apache | 1 | apache licence | (?:the )?apache licence
apache | 1 | apache software license | (?:the )?apache software license
apache | 2 | apache 2 0 license | apache 2 0 license
apache | 2 | spdx license identifier apache | spdx license identifier apache 2 0
apache | 2 | apache 2 0 | apache 2 0
gpl-2.0 | 2 | gpl 2 0 | gpl 2 0(?: only| or later)?
gpl-2.0 | 2 | gplv2 | gplv2(?: 0)?(?: only| or later)?
gpl-2.0 | 2 | gpl v2 | gpl v2(?: 0)?(?: only| or later)?
gpl-3.0 | 2 | gpl 3 0 | gpl 3 0(?: only| or later)?
gpl-3.0 | 2 | gplv3 | gplv3(?: 0)?(?: only| or later)?
gpl-3.0 | 2 | gpl v3 | gpl v3(?: 0)?(?: only| or later)?
lgpl-2.1 | 2 | lgpl 2 1 | lgpl 2 1(?: only| or later)?
lgpl-2.1 | 2 | lgplv2 1 | lgplv2 1(?: only| or later)?
lgpl-3.0 | 2 | lgpl 3 0 | lgpl 3 0(?: only| or later)?
lgpl-3.0 | 2 | lgplv3 | lgplv3(?: 0)?(?: only| or later)?
agpl-3.0 | 2 | agpl 3 0 | agpl 3 0(?: only| or later)?
agpl-3.0 | 2 | agplv3 | agplv3(?: 0)?(?: only| or later)?
mpl-2.0 | 2 | mpl 2 0 | mpl 2 0
epl-1.0 | 2 | epl 1 0 | epl 1 0
epl-2.0 | 2 | epl 2 0 | epl 2 0
gpl | 0 | terms of the gnu general public license | (?:redistribute it and or modify it )?under the terms of the gnu general public license(?: as published by the free software foundation)?
gpl | 1 | gnu general public license | (?:the )?gnu general public license
gpl | 1 | gnu general public licence | (?:the )?gnu general public licence
gpl | 2 | gnu gpl | (?:the )?gnu gpl
gpl | 2 | licensed under the gpl | licensed under the gpl
gpl | 2 | under the gpl | (?:released|distributed|available) under the gpl
lgpl | 0 | terms of the gnu lesser general public license | (?:redistribute it and or modify it )?under the terms of the gnu lesser general public license(?: as published by the free software foundation)?
lgpl | 1 | gnu lesser general public license | (?:the )?gnu lesser general public license
lgpl | 1 | gnu library general public license | (?:the )?gnu library general public license
lgpl | 1 | lesser general public license | (?:the )?lesser general public license
lgpl | 2 | gnu lgpl | (?:the )?gnu lgpl
agpl | 0 | terms of the gnu affero general public license | (?:redistribute it and or modify it )?under the terms of the gnu affero general public license(?: as published by the free software foundation)?
agpl | 1 | gnu affero general public license | (?:the )?gnu affero general public license
agpl | 1 | affero general public license | (?:the )?affero general public license
agpl | 2 | gnu agpl | (?:the )?gnu agpl
gfdl | 0 | terms of the gnu free documentation license | under the terms of the gnu free documentation license
gfdl | 1 | gnu free documentation license | (?:the )?gnu free documentation license
mpl | 0 | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license(?: v 2 0)?
mpl | 1 | mozilla public license | (?:the )?mozilla public license
epl | 1 | eclipse public license | (?:the )?eclipse public license
edl | 1 | eclipse distribution license | (?:the )?eclipse distribution license
cddl | 1 | common development and distribution license | (?:the )?common development and distribution license
cpl | 1 | common public license | (?:the )?common public license
cpal | 1 | common public attribution license | (?:the )?common public attribution license
ipl | 1 | ibm public license | (?:the )?ibm public license
artistic | 1 | artistic license | (?:the )?(?:perl )?artistic license
boost | 0 | boost software license version 1 0 | (?:the )?boost software license version 1 0
boost | 1 | boost software license | (?:the )?boost software license
zlib | 0 | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software(?: license)?
zlib | 1 | zlib license | (?:the )?zlib(?: libpng)? license
libpng | 1 | libpng license | (?:the )?libpng license
openssl | 1 | openssl license | (?:the )?openssl license
ssleay | 1 | ssleay license | (?:the )?(?:original )?ssleay license
php | 1 | php license | (?:the )?php license
python | 1 | python software foundation license | (?:the )?python software foundation license
python | 2 | psf license | (?:the )?psf license
ruby | 1 | ruby license | (?:the )?ruby license
postgresql | 1 | postgresql license | (?:the )?postgresql license
ntp | 1 | ntp license | (?:the )?ntp license
ncsa | 1 | ncsa open source license | (?:the )?(?:university of illinois )?ncsa open source license
w3c | 1 | w3c software license | (?:the )?w3c software(?: notice and)? license
w3c | 1 | w3c software notice and license | (?:the )?w3c software notice and license
unicode | 1 | unicode license | (?:the )?unicode license(?: agreement)?
icu | 1 | icu license | (?:the )?icu license
curl | 1 | curl license | (?:the )?curl license
vim | 1 | vim license | (?:the )?vim license
tcl | 1 | tcl tk license | (?:the )?tcl tk license
beerware | 1 | beer ware license | (?:the )?beer ware license
beerware | 1 | beerware license | (?:the )?beerware license
wtfpl | 1 | do what the fuck you want to public license | (?:the )?do what the fuck you want to public license
wtfpl | 2 | wtfpl | wtfpl
unlicense | 0 | free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 1 | the unlicense | (?:released under )?the unlicense
unlicense | 2 | spdx license identifier unlicense | spdx license identifier unlicense
fair | 1 | fair license | (?:the )?fair license
upl | 1 | universal permissive license | (?:the )?universal permissive license
eupl | 1 | european union public licence | (?:the )?european union public licence
eupl | 1 | european union public license | (?:the )?european union public license
cecill | 1 | cecill license | (?:the )?cecill(?: [abc])? license
mulan | 1 | mulan permissive software license | (?:the )?mulan permissive software license
ms-pl | 1 | microsoft public license | (?:the )?microsoft public license
ms-rl | 1 | microsoft reciprocal license | (?:the )?microsoft reciprocal license
apsl | 1 | apple public source license | (?:the )?apple public source license
qpl | 1 | q public license | (?:the )?q public license
osl | 1 | open software license | (?:the )?open software license
afl | 1 | academic free license | (?:the )?academic free license
ecl | 1 | educational community license | (?:the )?educational community license
lppl | 1 | latex project public license | (?:the )?latex project public license
ofl | 0 | licensed under the sil open font license | this font software is licensed under the sil open font license version 1 1
ofl | 1 | sil open font license | (?:the )?sil open font license
ofl | 1 | open font license | (?:the )?open font license
ubuntu-font | 1 | ubuntu font licence | (?:the )?ubuntu font licence
bitstream-vera | 1 | bitstream vera license | (?:the )?bitstream vera license
sleepycat | 1 | sleepycat license | (?:the )?sleepycat license
json | 0 | software shall be used for good not evil license | the software shall be used for good not evil license
json | 1 | json license | (?:the )?json license
elastic | 1 | elastic license | (?:the )?elastic license
sspl | 1 | server side public license | (?:the )?server side public license
busl | 1 | business source license | (?:the )?business source license
commons-clause | 1 | commons clause license | (?:the )?commons clause license(?: condition)?
polyform | 1 | polyform noncommercial license | (?:the )?polyform noncommercial license
polyform | 1 | polyform small business license | (?:the )?polyform small business license
polyform | 1 | polyform shield license | (?:the )?polyform shield license
parity | 1 | parity public license | (?:the )?parity public license
hippocratic | 1 | hippocratic license | (?:the )?hippocratic license
blue-oak | 1 | blue oak model license | (?:the )?blue oak model license
odbl | 0 | open database license odbl | (?:the )?open database license odbl(?: v 1 0)?
odbl | 1 | open database license | (?:the )?open database license
odc-by | 1 | open data commons attribution license | (?:the )?open data commons attribution license
pddl | 1 | public domain dedication and license | (?:the )?(?:open data commons )?public domain dedication and license
cdla | 1 | community data license agreement | (?:the )?community data license agreement(?: permissive| sharing)?
ogl-uk | 1 | open government licence | (?:the )?open government licence
free-art | 1 | free art license | (?:the )?free art license
rail | 1 | openrail license | (?:creativeml )?openrail(?: m)? license
rail | 1 | responsible ai license | (?:the )?responsible ai license
llama | 1 | llama community license | (?:the )?llama(?: [0-9]+)? community license(?: agreement)?
gemma | 1 | gemma terms of use license | gemma terms of use license
cc0 | 0 | cc0 1 0 universal | (?:the )?(?:creative commons )?cc0 1 0 universal(?: public domain dedication)?
cc0 | 1 | creative commons zero | creative commons zero
cc0 | 2 | cc0 | cc0
cc-by | 1 | creative commons attribution | (?:the )?creative commons attribution(?: license)?
cc-by | 2 | cc by | cc by
cc-by-sa | 1 | creative commons attribution share alike | (?:the )?creative commons attribution share alike(?: license)?
cc-by-sa | 1 | creative commons attribution sharealike | (?:the )?creative commons attribution sharealike(?: license)?
cc-by-nc | 1 | creative commons attribution noncommercial | (?:the )?creative commons attribution noncommercial(?: license)?
cc-by-nc | 1 | creative commons attribution non commercial | (?:the )?creative commons attribution non commercial(?: license)?
cc-by-nd | 1 | creative commons attribution noderivatives | (?:the )?creative commons attribution noderivatives(?: license)?
cc-by-nd | 1 | creative commons attribution no derivatives | (?:the )?creative commons attribution no derivatives(?: license)?
creative-commons | 1 | creative commons license | (?:a |the )?creative commons license
creative-commons | 1 | creative commons licence | (?:a |the )?creative commons licence
public-domain | 1 | released into the public domain | released into the public domain
public-domain | 1 | dedicated to the public domain | dedicated to the public domain
public-domain | 3 | in the public domain | (?:is )?in the public domain
all-rights-reserved | 3 | all rights reserved | all rights reserved
copyright | 3 | copyright c | copyright c (?:19|20)[0-9][0-9]
copyright | 3 | copyright | copyright (?:19|20)[0-9][0-9]
warranty-disclaimer | 3 | without warranty of any kind | (?:the software is )?provided as is without warranty of any kind
warranty-disclaimer | 3 | without any warranty | (?:but )?without any warranty(?: without even the implied warranty of merchantability)?
proprietary | 3 | proprietary license | (?:a |the )?proprietary license
proprietary | 3 | end user license agreement | end user license agreement
proprietary | 3 | unauthorized copying of this file copyright | unauthorized copying of this file copyright
"""

#: Families: label, keyword and expression over the versions given; tiers 0 (full name) and 2 (identifier).
_VERSIONED = [
    ("gpl", "gnu general public license", "gpl", ("1", "2", "3")),
    ("lgpl", "gnu lesser general public license", "lgpl", ("2", "2 1", "3")),
    ("agpl", "gnu affero general public license", "agpl", ("1", "3")),
    ("gfdl", "gnu free documentation license", "gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla public license", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public license", "epl", ("1 0", "2 0")),
    ("cddl", "common development and distribution license", "cddl", ("1 0", "1 1")),
    ("eupl", "european union public licence", "eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic license", "artistic", ("1 0", "2 0")),
    ("osl", "open software license", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free license", "afl", ("1 2", "2 0", "2 1", "3 0")),
    ("lppl", "latex project public license", "lppl", ("1 0", "1 1", "1 2", "1 3")),
    ("php", "php license", "php", ("3 0", "3 01")),
    ("zpl", "zope public license", "zpl", ("1 1", "2 0", "2 1")),
]
_CC = [("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nd", "by nd", "attribution no ?derivatives"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?derivatives")]
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _families() -> list[tuple[str, int, str, str]]:
    found = []
    for label, name, short, versions in _VERSIONED:
        for v in versions:
            tail = "" if " " in v else "(?: 0)?"
            found.append((f"{label}-{v.replace(' ', '.')}", 0, name, rf"(?:the )?{name}(?: {short})? (?:version |v ?)?{v}{tail}(?: only| or (?:any |at your option any )?later(?: version)?)?"))
            found.append((f"{label}-{v.replace(' ', '.')}", 2, "license", rf"spdx license identifier {short} {v}{tail}(?: only| or later)?"))
    for label, short, long in _CC:
        for v in _CC_VERSIONS:
            found.append((f"{label}-{v.replace(' ', '.')}", 0, "cc by", rf"(?:licensed under )?cc {short} {v}(?: license)?"))
            found.append((f"{label}-{v.replace(' ', '.')}", 0, "creative commons", rf"creative commons {long} {v}(?: international| unported| generic)?(?: license)?"))
        if short != "by":
            found.append((label, 2, f"cc {short}", rf"cc {short}"))
    return found


def rules() -> list[tuple[str, int, str, str]]:
    """(label, tier, keyword, expression), in order of tier and then as written."""
    written = []
    for line in _WRITTEN.strip().splitlines():
        label, tier, keyword, expression = line.split(" | ")
        written.append((label, int(tier), keyword, expression))
    return sorted(written + _families(), key=lambda r: r[1])
