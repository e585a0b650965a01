"""Hand-written signature rules for licenses, in order of priority.

A rule is written over the words of a text: one blank stands between words, letters are lower case, and every
character that is not a letter or digit separates words ("GPL-2.0" is "gpl 2 0").  A pattern matches whole words.  Blanks
are widened before use, so an optional blank is written as a group: "share(?: )?alike".
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    #: 4 machine-readable tag, 3 grant with version, 2 name, 1 mention; 0 base phrases, which are never suppressed
    priority: int
    #: word that every match of the pattern holds, so that the pattern is tried only in texts with it; a pattern whose
    #: alternatives share no word is several rules
    keyword: str
    pattern: str
    confidence: float


#: The phrases every report holds.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# label; tag of the machine-readable form; keyword; name; version that may follow (empty: none)
_FAMILIES = """
apache-2.0; apache 2 0; apache; apache(?: software)? licen[sc]e; (?:version |v )?2(?: 0)?
apache-1.1; apache 1 1; apache; apache(?: software)? licen[sc]e; (?:version |v )?1 1
mit; mit; mit; mit licen[sc]e;
mit-0; mit 0; mit; mit no attribution(?: licen[sc]e)?;
bsd-2-clause; bsd 2 clause; bsd; (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?;
bsd-3-clause; bsd 3 clause; bsd; (?:new|revised|modified|3 clause|three clause) bsd(?: licen[sc]e)?;
bsd-4-clause; bsd 4 clause; bsd; (?:original|4 clause|four clause) bsd(?: licen[sc]e)?;
0bsd; 0bsd; 0bsd; 0bsd(?: licen[sc]e)?;
0bsd; 0bsd; zero; zero clause bsd(?: licen[sc]e)?;
gpl-1.0; gpl 1 0(?: only| or later)?; general; gnu general public licen[sc]e; (?:version |v )?1(?: 0)?
gpl-2.0; gpl 2 0(?: only| or later)?; general; (?:gnu )?general public licen[sc]e; (?:version |v )?2(?: 0)?
gpl-3.0; gpl 3 0(?: only| or later)?; general; (?:gnu )?general public licen[sc]e; (?:version |v )?3(?: 0)?
lgpl-2.0; lgpl 2 0(?: only| or later)?; library; (?:gnu )?library general public licen[sc]e; (?:version |v )?2(?: 0)?
lgpl-2.1; lgpl 2 1(?: only| or later)?; lesser; (?:gnu )?lesser general public licen[sc]e; (?:version |v )?2 1
lgpl-3.0; lgpl 3 0(?: only| or later)?; lesser; (?:gnu )?lesser general public licen[sc]e; (?:version |v )?3(?: 0)?
agpl-3.0; agpl 3 0(?: only| or later)?; affero; (?:gnu )?affero general public licen[sc]e; (?:version |v )?3(?: 0)?
gfdl-1.1; gfdl 1 1(?: only| or later)?; documentation; (?:gnu )?free documentation licen[sc]e; (?:version |v )?1 1
gfdl-1.2; gfdl 1 2(?: only| or later)?; documentation; (?:gnu )?free documentation licen[sc]e; (?:version |v )?1 2
gfdl-1.3; gfdl 1 3(?: only| or later)?; documentation; (?:gnu )?free documentation licen[sc]e; (?:version |v )?1 3
mpl-1.0; mpl 1 0; mozilla; mozilla public licen[sc]e; (?:version |v )?1 0
mpl-1.1; mpl 1 1; mozilla; mozilla public licen[sc]e; (?:version |v )?1 1
mpl-2.0; mpl 2 0; mozilla; mozilla public licen[sc]e; (?:version |v )?2(?: 0)?
epl-1.0; epl 1 0; eclipse; eclipse public licen[sc]e; (?:version |v )?1(?: 0)?
epl-2.0; epl 2 0; eclipse; eclipse public licen[sc]e; (?:version |v )?2(?: 0)?
edl-1.0; edl 1 0; eclipse; eclipse distribution licen[sc]e; (?:version |v )?1(?: 0)?
cddl-1.0; cddl 1 0; distribution; common development and distribution licen[sc]e; (?:version |v )?1 0
cddl-1.1; cddl 1 1; distribution; common development and distribution licen[sc]e; (?:version |v )?1 1
cpl-1.0; cpl 1 0; common; common public licen[sc]e; (?:version |v )?1(?: 0)?
cpal-1.0; cpal 1 0; attribution; common public attribution licen[sc]e; (?:version |v )?1(?: 0)?
ipl-1.0; ipl 1 0; ibm; ibm public licen[sc]e; (?:version |v )?1(?: 0)?
artistic-1.0; artistic 1 0; artistic; artistic licen[sc]e; (?:version |v )?1(?: 0)?
artistic-2.0; artistic 2 0; artistic; artistic licen[sc]e; (?:version |v )?2(?: 0)?
afl-2.1; afl 2 1; academic; academic free licen[sc]e; (?:version |v )?2 1
afl-3.0; afl 3 0; academic; academic free licen[sc]e; (?:version |v )?3(?: 0)?
osl-2.1; osl 2 1; open; open software licen[sc]e; (?:version |v )?2 1
osl-3.0; osl 3 0; open; open software licen[sc]e; (?:version |v )?3(?: 0)?
ecl-2.0; ecl 2 0; educational; educational community licen[sc]e; (?:version |v )?2(?: 0)?
eupl-1.1; eupl 1 1; european; european union public licen[sc]e; (?:version |v )?1 1
eupl-1.2; eupl 1 2; european; european union public licen[sc]e; (?:version |v )?1 2
isc; isc; isc; isc licen[sc]e;
zlib; zlib; zlib; zlib(?: libpng)? licen[sc]e;
libpng; libpng(?: 2 0)?; libpng; libpng licen[sc]e;
libpng; libpng(?: 2 0)?; png; png reference library licen[sc]e;
bsl-1.0; bsl 1 0; boost; boost software licen[sc]e; (?:version |v )?1(?: 0)?
busl-1.1; busl 1 1; business; business source licen[sc]e; (?:version |v )?1 1
sspl-1.0; sspl 1 0; server; server side public licen[sc]e; (?:version |v )?1
elastic-2.0; elastic 2 0; elastic; elastic licen[sc]e; (?:version |v )?2(?: 0)?
unlicense; unlicense; unlicense; (?:the )?unlicense;
wtfpl; wtfpl; want; do what the f\\w* you want to public licen[sc]e; (?:version |v )?2
cc0-1.0; cc0 1 0; cc0; cc0; 1 0(?: universal)?
cc-by-1.0; cc by 1 0; cc; cc by; 1 0
cc-by-2.0; cc by 2 0; cc; cc by; 2 0
cc-by-2.5; cc by 2 5; cc; cc by; 2 5
cc-by-3.0; cc by 3 0; cc; cc by; 3 0
cc-by-4.0; cc by 4 0; cc; cc by; 4 0
cc-by-sa-2.0; cc by sa 2 0; cc; cc by sa; 2 0
cc-by-sa-3.0; cc by sa 3 0; cc; cc by sa; 3 0
cc-by-sa-4.0; cc by sa 4 0; cc; cc by sa; 4 0
cc-by-nd-3.0; cc by nd 3 0; cc; cc by nd; 3 0
cc-by-nd-4.0; cc by nd 4 0; cc; cc by nd; 4 0
cc-by-nc-2.0; cc by nc 2 0; cc; cc by nc; 2 0
cc-by-nc-3.0; cc by nc 3 0; cc; cc by nc; 3 0
cc-by-nc-4.0; cc by nc 4 0; cc; cc by nc; 4 0
cc-by-nc-sa-3.0; cc by nc sa 3 0; cc; cc by nc sa; 3 0
cc-by-nc-sa-4.0; cc by nc sa 4 0; cc; cc by nc sa; 4 0
cc-by-nc-nd-3.0; cc by nc nd 3 0; cc; cc by nc nd; 3 0
cc-by-nc-nd-4.0; cc by nc nd 4 0; cc; cc by nc nd; 4 0
odbl-1.0; odbl 1 0; database; open (?:data commons open )?database licen[sc]e; (?:version |v )?1 0
odc-by-1.0; odc by 1 0; commons; open data commons attribution licen[sc]e; (?:version |v )?1 0
pddl-1.0; pddl 1 0; dedication; (?:open data commons )?public domain dedication and licen[sc]e; (?:version |v )?1 0
ofl-1.1; ofl 1 1; font; (?:sil )?open font licen[sc]e; (?:version |v )?1 1
psf-2.0; psf 2 0; python; python software foundation licen[sc]e; (?:version |v )?2
php-3.01; php 3 01; php; php licen[sc]e; (?:version |v )?3 01
ruby; ruby; ruby; ruby licen[sc]e;
vim; vim; vim; vim licen[sc]e;
openssl; openssl; openssl; openssl licen[sc]e;
postgresql; postgresql; postgresql; postgresql licen[sc]e;
x11; x11; x11; x11 licen[sc]e;
curl; curl; curl; curl licen[sc]e;
ncsa; ncsa; ncsa; (?:university of illinois )?ncsa(?: open source)? licen[sc]e;
upl-1.0; upl 1 0; universal; universal permissive licen[sc]e; (?:version |v )?1 0
mulan-2.0; mulanpsl 2 0; mulan; mulan permissive(?: software)? licen[sc]e; (?:version |v )?2
ms-pl; ms pl; microsoft; microsoft public licen[sc]e;
ms-rl; ms rl; microsoft; microsoft reciprocal licen[sc]e;
bluedoc; blueoak 1 0 0; blue; blue oak model licen[sc]e; (?:version |v )?1 0 0
openrail-m; openrail(?: m)?; openrail; (?:creativeml )?openrail(?: m)?(?: licen[sc]e)?;
"""

# label; abbreviation with its version; version that follows as a word of its own or in parts
_ABBREVIATIONS = """
gpl-1.0; gpl; 1; 1(?: 0)?
gpl-2.0; gpl; 2; 2(?: 0)?
gpl-3.0; gpl; 3; 3(?: 0)?
lgpl-2.0; lgpl; 2; 2(?: 0)?
lgpl-2.1; lgpl; 2 1; 2 1
lgpl-3.0; lgpl; 3; 3(?: 0)?
agpl-3.0; agpl; 3; 3(?: 0)?
gfdl-1.3; gfdl; 1 3; 1 3
mpl-2.0; mpl; 2; 2(?: 0)?
epl-2.0; epl; 2; 2(?: 0)?
eupl-1.2; eupl; 1 2; 1 2
"""

#: What stands before "or" in an expression of tags: a tag with a version, or one of a single word.
_MEMBER = "(?:[a-z]+(?: [0-9]+){1,2}(?: only| or later| clause)?|mit|isc|zlib|unlicense|0bsd|x11|ncsa)"
_LATER = "(?: only| or later| or any later version)?"

# label; keyword; pattern; confidence: statements without a family
_MENTIONS = """
cc-by; creative; creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?; 0.9
cc-by-sa; creative; creative commons attribution share(?: )?alike(?: [1-4] [05])?; 0.9
cc-by-nc; creative; creative commons attribution non(?: )?commercial(?: [1-4] [05])?; 0.9
cc-by-nd; creative; creative commons attribution no(?: )?deriv(?:s|atives|ative works)(?: [1-4] [05])?; 0.9
cc-by-nc-sa; creative; creative commons attribution non(?: )?commercial share(?: )?alike(?: [1-4] [05])?; 0.9
cc-by-nc-nd; creative; creative commons attribution non(?: )?commercial no(?: )?deriv(?:s|atives|ative works)(?: [1-4] [05])?; 0.9
creative-commons; creative; creative commons(?: public)? licen[sc]es?; 0.6
public-domain; domain; (?:in|into|to) the public domain; 0.7
public-domain; domain; public domain (?:work|mark|dedication); 0.7
proprietary; confidential; proprietary and confidential; 0.8
proprietary; property; is the (?:sole )?property of; 0.4
proprietary; permission; without (?:the )?(?:express |prior )*(?:written )?permission; 0.5
proprietary; prohibited; (?:unauthori[sz]ed )?(?:copying|reproduction|redistribution)(?: or \\w+)?(?: of this \\w+)? is (?:strictly )?prohibited; 0.7
copyright; copyright; copyright(?: c)? (?:19|20)[0-9]{2}; 0.5
copyright; copyrighted; copyrighted (?:material|work|content); 0.5
copyright; copr; copr (?:19|20)[0-9]{2}; 0.4
permissive; permission; permission is hereby granted(?: free of charge)?; 0.8
permissive; permission; permission to use copy modify and(?: or)? distribute; 0.8
permissive; redistribution; redistribution and use in source and binary forms; 0.8
warranty-disclaimer; warranty; without warranty of any kind; 0.5
warranty-disclaimer; warranties; without warranties or conditions of any kind; 0.5
free-software; software; this (?:program|library) is free software; 0.7
copyleft; option; at your option any later version; 0.6
copyleft; copyleft; copyleft; 0.4
commercial-restriction; commercial; (?:for )?non commercial (?:use|purposes) only; 0.7
commercial-restriction; commercial; not for commercial use; 0.7
share-alike; alike; share alike; 0.4
terms; terms; terms (?:of use|of service|and conditions) apply; 0.4
licensed; terms; (?:licensed|released|distributed|available) under (?:the )?terms; 0.4
royalty-free; royalty; royalty free licen[sc]e; 0.5
perpetual; perpetual; perpetual worldwide non exclusive; 0.6
open-government; government; open government licen[sc]e(?: (?:v|version)(?: )?[1-3](?: 0)?)?; 0.8
crown-copyright; crown; crown copyright; 0.7
eula; eula; eula; 0.5
eula; agreement; end user licen[sc]e agreement; 0.7
bsd; bsd; bsd(?: style)? licen[sc]e; 0.6
gpl; gpl; (?:gnu )?gpl; 0.5
lgpl; lgpl; (?:gnu )?lgpl; 0.5
agpl; agpl; (?:gnu )?agpl; 0.5
"""


def rules() -> list[Rule]:
    """All rules: base phrases; for each family its tag, alone and in expressions, its grants and its names; then
    abbreviations and mentions."""
    found = [Rule(label, 0, phrase.split()[0], phrase, 1.0) for phrase, label in BASE.items()]
    for line in _FAMILIES.strip().splitlines():
        label, tag, keyword, name, version = (part.strip() for part in line.split(";"))
        version = version.replace("(?:version |v )?", "(?:version |ver |v )?v?")
        first = re.match(r"\w+", tag).group()
        found.append(Rule(label, 4, "spdx", f"spdx license identifier {tag}", 1.0))
        found.append(Rule(label, 3, first, f"licen[sc]e(?:s|d)?(?: is| type| expression| under)?(?: the)? {tag}", 0.95))
        if " " in tag and tag != "mit 0":
            found.append(Rule(label, 3, first, tag, 0.85))
        else:
            found.append(Rule(label, 1, first, f"{_MEMBER} (?:or|and) {tag}", 0.85))
        dated = f"(?:the )?{name} {version}" if version else f"(?:the )?{name}"
        grant = f"(?:is |are )?(?:licen[sc]ed|released|distributed|available|provided) under {dated}"
        found.append(Rule(label, 3, keyword, grant, 0.95))
        found.append(Rule(label, 2, keyword, dated, 0.8))
        if version:
            found.append(Rule(label.rpartition("-")[0], 1, keyword, name, 0.6))
    for line in _ABBREVIATIONS.strip().splitlines():
        label, short, joined, version = (part.strip() for part in line.split(";"))
        found.append(Rule(label, 3, short, f"(?:gnu )?{short} (?:version |ver |v )?v?{version}{_LATER}", 0.9))
        for mark in ("v", ""):
            word = f"{short}{mark}{joined.split()[0]}"
            rest = joined.split()[1] if " " in joined else ""
            found.append(Rule(label, 3, word, f"(?:gnu )?{word}{f' {rest}' if rest else '(?: 0)?'}{_LATER}", 0.9))
    for line in _MENTIONS.strip().splitlines():
        label, keyword, pattern, confidence = (part.strip() for part in line.split(";"))
        found.append(Rule(label, 1, keyword, pattern, float(confidence)))
    return list(dict.fromkeys(found))
