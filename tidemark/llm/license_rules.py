"""Signatures of licences: ordered, hand-written patterns over words.

A pattern is written over lower-case words: an atom is a regular expression for one word, ``*`` is any word,
``( .. | .. )`` chooses and ``( .. )?`` is optional.  Each signature names a word that every one of its
matches holds; a text without that word is never searched for it.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    #: 0 base phrase, 1 identifier or grant text, 2 name with version, 3 name alone, 4 address, 5 hint.
    level: int
    keyword: str
    pattern: str


#: What a detection of a level is worth.
CONFIDENCE = (1.0, 1.0, 0.9, 0.75, 0.6, 0.25)

_UNDER = "((licen[cs]ed|released|distributed|published|available|provided|covered|redistributed) under )?(the )?(terms of )?(the )?"

#: Names with a version, or names that mean one text: label, keyword, pattern.
_NAMES = """
mit             mit          mit (x11 |expat )?licen[cs]e
mit             mit          mit licen[cs]ed
mit             mit          licen[cs]e mit
mit             expat        expat licen[cs]e
mit-0           mit          mit (0|no attribution) licen[cs]e
x11             x11          x11 licen[cs]e
isc             isc          isc licen[cs]e
apache-2        apache       apache (software |public )?licen[cs]e (version |v )?(2|v2) (0 )?
apache-2        apache       apache (version )?(2|v2) (0 )?(licen[cs]ed? )?
apache-2        apache2      apache2 (licen[cs]ed? )?
apache-2        asl          asl (v2|2) (0 )?
apache-1.1      apache       apache (software )?licen[cs]e (version )?1 1
apache-1.0      apache       apache (software )?licen[cs]e (version )?1 0
gpl-1           gnu          gnu general public licen[cs]e (version |v )?1 (0 )?
gpl-2           gnu          gnu general public licen[cs]e (version |v )?(2|v2) (0 )?(only )?
gpl-2-plus      gnu          gnu general public licen[cs]e (version |v )?(2|v2) (0 )?(of the licen[cs]e )?or (at your option )?(any )?(later|newer) (version )?
gpl-2           gpl          (gnu )?gpl (version |v )?(2|v2) (0 )?(only )?
gpl-2           gplv2        (gnu )?gplv2 (only )?
gpl-2-plus      gpl          (gnu )?gpl (version |v )?(2|v2) (0 )?or (any )?later (version )?
gpl-3           gnu          gnu general public licen[cs]e (version |v )?(3|v3) (0 )?(only )?
gpl-3-plus      gnu          gnu general public licen[cs]e (version |v )?(3|v3) (0 )?(of the licen[cs]e )?or (at your option )?(any )?(later|newer) (version )?
gpl-3           gpl          (gnu )?gpl (version |v )?(3|v3) (0 )?(only )?
gpl-3           gplv3        (gnu )?gplv3 (only )?
gpl-3-plus      gpl          (gnu )?gpl (version |v )?(3|v3) (0 )?or (any )?later (version )?
lgpl-2          library      gnu library general public licen[cs]e (version |v )?(2|v2) (0 )?
lgpl-2.1        lesser       (gnu )?lesser general public licen[cs]e (version |v )?(2|v2) 1 (only )?
lgpl-2.1-plus   lesser       (gnu )?lesser general public licen[cs]e (version |v )?(2|v2) 1 (of the licen[cs]e )?or (at your option )?(any )?later (version )?
lgpl-2.1        lgpl         (gnu )?lgpl (version |v )?(2|v2) 1
lgpl-2.1        lgplv2       (gnu )?lgplv2 1
lgpl-3          lesser       (gnu )?lesser general public licen[cs]e (version |v )?(3|v3) (0 )?
lgpl-3-plus     lesser       (gnu )?lesser general public licen[cs]e (version |v )?(3|v3) (0 )?(of the licen[cs]e )?or (at your option )?(any )?later (version )?
lgpl-3          lgpl         (gnu )?lgpl (version |v )?(3|v3) (0 )?
lgpl-3          lgplv3       (gnu )?lgplv3
agpl-3          affero       (gnu )?affero general public licen[cs]e (version |v )?(3|v3) (0 )?
agpl-3-plus     affero       (gnu )?affero general public licen[cs]e (version |v )?(3|v3) (0 )?(of the licen[cs]e )?or (at your option )?(any )?later (version )?
agpl-3          agpl         (gnu )?agpl (version |v )?(3|v3) (0 )?
agpl-3          agplv3       (gnu )?agplv3
fdl-1.2         documentation  gnu free documentation licen[cs]e (version |v )?1 2
fdl-1.3         documentation  gnu free documentation licen[cs]e (version |v )?1 3
bsd-2           bsd          (bsd (2|two) clause|(2|two) clause bsd|simplified bsd|freebsd bsd) (licen[cs]ed? )?
bsd-3           bsd          (bsd (3|three) clause|(3|three) clause bsd|new bsd|modified bsd|revised bsd) (licen[cs]ed? )?
bsd-4           bsd          (bsd (4|four) clause|(4|four) clause bsd|original bsd|old bsd) (licen[cs]ed? )?
bsd-0           bsd          (bsd (0|zero) clause|(0|zero) clause bsd) (licen[cs]ed? )?
mpl-1.1         mozilla      mozilla public licen[cs]e (version |v )?1 1
mpl-1.0         mozilla      mozilla public licen[cs]e (version |v )?1 0
mpl-2           mozilla      mozilla public licen[cs]e (version |v )?(2|v2) (0 )?
mpl-2           mpl          mpl (version |v )?(2|v2) (0 )?
mpl-1.1         mpl          mpl (version |v )?1 1
epl-1           eclipse      eclipse public licen[cs]e (version |v )?(1|v10|v1) (0 )?
epl-2           eclipse      eclipse public licen[cs]e (version |v )?(2|v20|v2) (0 )?
epl-2           epl          epl (version |v )?2 (0 )?
epl-1           epl          epl (version |v )?1 (0 )?
edl-1           eclipse      eclipse distribution licen[cs]e (version |v )?1 (0 )?
cddl-1.0        distribution common development and distribution licen[cs]e (version |v )?1 0
cddl-1.1        distribution common development and distribution licen[cs]e (version |v )?1 1
cddl-1.0        cddl         cddl (version |v )?1 0
eupl-1.1        union        european union public licen[cs]e (version |v )?1 1
eupl-1.2        union        european union public licen[cs]e (version |v )?1 2
eupl-1.2        eupl         eupl (version |v )?1 2
osl-3           osl          (open software licen[cs]e )?osl (version |v )?3 (0 )?
osl-3           software     open software licen[cs]e (version |v )?3 (0 )?
afl-3           academic     academic free licen[cs]e (version |v )?3 (0 )?
afl-2.1         academic     academic free licen[cs]e (version |v )?2 1
artistic-1      artistic     artistic licen[cs]e (version |v )?1 (0 )?
artistic-2      artistic     artistic licen[cs]e (version |v )?2 (0 )?
boost-1         boost        boost software licen[cs]e (version |v )?(1 0 )?
boost-1         bsl          bsl 1 0
bsl-1.1         business     business source licen[cs]e (version |v )?(1 1 )?
sspl-1          server       server side public licen[cs]e (version |v )?(1 )?
elastic-2       elastic      elastic licen[cs]e (version |v )?(2|v2) (0 )?
zlib            zlib         zlib (libpng )?licen[cs]e
libpng          libpng       libpng licen[cs]e (version |v )?(2 )?
unlicense       unlicense    (the )?unlicense
wtfpl           wtfpl        wtfpl (version )?(2 )?
wtfpl           fuck         do what the fuck you want to public licen[cs]e
cc0             cc0          cc0 (1 0 )?(universal )?
cc-by           cc           cc by (1 0|2 0|2 5|3 0|4 0)
cc-by-sa        cc           cc by sa (1 0|2 0|2 5|3 0|4 0)?
cc-by-nd        cc           cc by nd (1 0|2 0|2 5|3 0|4 0)?
cc-by-nc        cc           cc by nc (1 0|2 0|2 5|3 0|4 0)?
cc-by-nc-sa     cc           cc by nc sa (1 0|2 0|2 5|3 0|4 0)?
cc-by-nc-nd     cc           cc by nc nd (1 0|2 0|2 5|3 0|4 0)?
cc-by           attribution  creative commons attribution (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc-by-sa        sharealike   creative commons attribution sharealike (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc-by-sa        alike        creative commons attribution share alike (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc-by-nd        noderivatives  creative commons attribution noderivatives (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc-by-nd        derivatives  creative commons attribution no derivatives (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc-by-nc        noncommercial  creative commons attribution noncommercial (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc-by-nc        commercial   creative commons attribution non commercial (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc-by-nc-sa     sharealike   creative commons attribution noncommercial sharealike (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc-by-nc-nd     noderivatives  creative commons attribution noncommercial noderivatives (1 0|2 0|2 5|3 0|4 0)? (international |unported )?(public )?(licen[cs]e )?
cc0             creative     creative commons (cc0|zero) (1 0 )?(universal )?
odbl-1          odbl         odbl (version |v )?(1 0 )?
odbl-1          database     open (data commons open )?database licen[cs]e
odc-by-1        commons      open data commons attribution licen[cs]e
pddl-1          dedication   public domain dedication and licen[cs]e
ogl-3           government   open government licen[cs]e (version |v )?(3|v3) (0 )?
ogl-2           government   open government licen[cs]e (version |v )?(2|v2) (0 )?
ofl-1.1         sil          sil open font licen[cs]e (version |v )?(1 1 )?
ofl-1.1         ofl          ofl (version |v )?1 1
python-2        python       python (software foundation )?licen[cs]e (version |v )?(2 )?
php-3           php          php licen[cs]e (version |v )?3 (01 |0 )?
ruby            ruby         ruby licen[cs]e
postgresql      postgresql   postgresql licen[cs]e
openssl         openssl      openssl licen[cs]e
curl            curl         curl licen[cs]e
vim             vim          vim licen[cs]e
json            json         json licen[cs]e
beerware        beerware     beerware (licen[cs]e )?
beerware        beer         beer ware licen[cs]e
ncsa            ncsa         (university of illinois )?ncsa (open source )?licen[cs]e
ms-pl           microsoft    microsoft public licen[cs]e
ms-rl           microsoft    microsoft reciprocal licen[cs]e
upl-1           universal    universal permissive licen[cs]e (version |v )?(1 0 )?
ipl-1           ibm          ibm public licen[cs]e (version |v )?(1 0 )?
cpl-1           common       common public licen[cs]e (version |v )?(1 0 )?
cecill-2.1      cecill       cecill (free software licen[cs]e )?(agreement )?(version |v )?2 1
cecill-b        cecill       cecill b
cecill-c        cecill       cecill c
ecl-2           educational  educational community licen[cs]e (version |v )?(2 0 )?
llama-2         llama        llama 2 community licen[cs]e (agreement )?
llama-3         llama        (meta )?llama 3 (1 |2 |3 )?community licen[cs]e (agreement )?
openrail        openrail     (creativeml |bigscience |bigcode )?openrail (m )?(licen[cs]e )?
gemma           gemma        gemma (terms of use|licen[cs]e)
mulan-2         mulan        mulan (psl|permissive software licen[cs]e) (v2|version 2)
unicode         unicode      unicode (data files and software )?licen[cs]e (agreement )?
w3c             w3c          w3c (software )?(notice and )?licen[cs]e
zpl-2.1         zope         zope public licen[cs]e (version |v )?2 1
hippocratic-2   hippocratic  hippocratic licen[cs]e (version |v )?2 (1 |0 )?
polyform-nc     polyform     polyform noncommercial licen[cs]e (1 0 0 )?
"""

#: Families named without a version.
_FAMILIES = """
apache          apache       apache (software |public )?licen[cs]e
gpl             gnu          gnu general public licen[cs]e
gpl             gpl          (gnu )?gpl
gpl             general      general public licen[cs]e
lgpl            lesser       (gnu )?lesser general public licen[cs]e
lgpl            lgpl         (gnu )?lgpl
agpl            affero       (gnu )?affero general public licen[cs]e
agpl            agpl         (gnu )?agpl
fdl             documentation  (gnu )?free documentation licen[cs]e
bsd             bsd          bsd (style |like |type )?licen[cs]ed?
mpl             mozilla      mozilla public licen[cs]e
epl             eclipse      eclipse public licen[cs]e
cddl            cddl         cddl (licen[cs]e )?
eupl            eupl         eupl (licen[cs]e )?
artistic        artistic     artistic licen[cs]e
ogl             government   open government licen[cs]e
ofl             font         open font licen[cs]e
php             php          php licen[cs]e
elastic         elastic      elastic licen[cs]e
creative-commons  commons    creative commons (licen[cs]ed?|public licen[cs]e)
cecill          cecill       cecill (licen[cs]e )?
public-domain   domain       (in|into|to) the public domain
public-domain   domain       public domain (dedication )?
"""

#: Sentences that only one licence has, and dedications.
_GRANTS = """
mit             hereby       permission is hereby granted free of charge to any person obtaining a copy of this software
mit             noninfringement  merchantability fitness for a particular purpose and noninfringement
isc             fee          permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted
bsd-2           redistributions  redistributions in binary form must reproduce the above copyright notice
bsd-3           endorse      neither the name of * (* )?(* )?(* )?(* )?nor the names of its contributors may be used to endorse or promote
bsd-4           advertising  all advertising materials mentioning features or use of this software must display
apache-2        compliance   you may not use this file except in compliance with the licen[cs]e
gpl             redistribute you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl            redistribute you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
mpl-2           mpl          this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0 if a copy of the mpl
zlib            misrepresented  the origin of this software must not be misrepresented
boost-1         accompanying permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense       unencumbered this is free and unencumbered software released into the public domain
wtfpl           fuck         you just do what the fuck you want to
cc0             waived       has waived all copyright and related (or|and) neighboring rights
beerware        beer         you can buy me a beer in return
json            evil         the software shall be used for good not evil
ofl-1.1         sil          this font software is licensed under the sil open font licen[cs]e
sspl-1          service      you must make the service source code available
artistic-2      artistic     this is free software licensed under the artistic licen[cs]e 2 0
public-domain   domain       placed in the public domain
"""

#: Addresses, cut at everything that is no letter or digit.
_ADDRESSES = """
mit             opensource   opensource org licen[cs]es? mit
apache-2        apache       (www )?apache org licenses licen[cs]e 2 0
apache-2        opensource   opensource org licen[cs]es? apache 2 0
bsd-2           opensource   opensource org licen[cs]es? bsd 2 clause
bsd-3           opensource   opensource org licen[cs]es? bsd 3 clause
isc             opensource   opensource org licen[cs]es? isc
gpl-2           gnu          (www )?gnu org licenses (old licenses )?gpl 2 0
gpl-3           gnu          (www )?gnu org licenses gpl 3 0
gpl             gnu          (www )?gnu org (licenses|copyleft) gpl
lgpl-2.1        gnu          (www )?gnu org licenses (old licenses )?lgpl 2 1
lgpl-3          gnu          (www )?gnu org licenses lgpl 3 0
agpl-3          gnu          (www )?gnu org licenses agpl 3 0
fdl             gnu          (www )?gnu org licenses fdl
mpl-2           mozilla      (www )?mozilla org (en us )?mpl 2 0
epl-2           eclipse      (www )?eclipse org legal epl (v20|2 0)
epl-1           eclipse      (www )?eclipse org legal epl v10
boost-1         boost        (www )?boost org licen[cs]e 1 0
cc-by           creativecommons  creativecommons org licenses by
cc-by-sa        creativecommons  creativecommons org licenses by sa
cc-by-nd        creativecommons  creativecommons org licenses by nd
cc-by-nc        creativecommons  creativecommons org licenses by nc
cc-by-nc-sa     creativecommons  creativecommons org licenses by nc sa
cc-by-nc-nd     creativecommons  creativecommons org licenses by nc nd
cc0             creativecommons  creativecommons org publicdomain zero
public-domain   creativecommons  creativecommons org publicdomain mark
odbl-1          opendatacommons  opendatacommons org licenses odbl
unlicense       unlicense    unlicense org
wtfpl           wtfpl        (www )?wtfpl net
ofl-1.1         sil          scripts sil org ofl
"""

#: Words that only hint at a licence.
_HINTS = """
proprietary     reserved     all rights reserved
proprietary     confidential proprietary and confidential
proprietary     prohibited   unauthorized (copying|use|distribution|reproduction) * (* )?(* )?(* )?(* )?(* )?is strictly prohibited
proprietary     propriétaire  licence propriétaire
proprietary     vorbehalten  alle rechte vorbehalten
proprietary     réservés     tous droits réservés
proprietary     reservados   todos los derechos reservados
unknown         under        (licen[cs]ed|released|distributed) under
unknown         licencia     (bajo|con) (la )?licencia
unknown         licence      sous (la )?licence
unknown         lizenz       unter (der )?(* )?lizenz
unknown         file         see (the )?licen[cs]e file
"""

#: Short identifiers behind the tag, by label.
_TAGGED = """
mit:mit mit-0:mit_0 isc:isc apache-2:apache_2_0 apache-1.1:apache_1_1 gpl-2:gpl_2_0 gpl-3:gpl_3_0 lgpl-2.1:lgpl_2_1 lgpl-3:lgpl_3_0
agpl-3:agpl_3_0 bsd-2:bsd_2_clause bsd-3:bsd_3_clause bsd-4:bsd_4_clause bsd-0:0bsd mpl-1.1:mpl_1_1 mpl-2:mpl_2_0 epl-1:epl_1_0 epl-2:epl_2_0
cddl-1.0:cddl_1_0 eupl-1.2:eupl_1_2 artistic-2:artistic_2_0 boost-1:bsl_1_0 zlib:zlib unlicense:unlicense wtfpl:wtfpl cc0:cc0_1_0
cc-by:cc_by_4_0 cc-by-sa:cc_by_sa_4_0 cc-by-nc:cc_by_nc_4_0 ofl-1.1:ofl_1_1 python-2:python_2_0 postgresql:postgresql upl-1:upl_1_0 ncsa:ncsa
"""


def _rows(text: str, level: int, lead: str = "") -> list[Rule]:
    return [Rule(label, level, keyword, lead + pattern) for label, keyword, pattern in (line.split(None, 2) for line in text.strip().splitlines())]


def signatures() -> list[Rule]:
    """All signatures in the order in which they win among equals."""
    tagged = [entry.split(":") for entry in _TAGGED.split()]
    return [
        *(Rule(label, 1, "spdx", f"spdx licen[cs]e identifier {name.replace('_', ' ')} (only |or later )?") for label, name in tagged),
        *_rows(_GRANTS, 1), *_rows(_NAMES, 2, _UNDER), *_rows(_FAMILIES, 3, _UNDER), *_rows(_ADDRESSES, 4), *_rows(_HINTS, 5),
    ]


def compiled(pattern: str) -> str:
    """The pattern over words that are written as `` word#place ``."""
    out = []
    for part in re.findall(r"\(|\)\??|\||[^\s()|]+", pattern):
        if part == "(":
            out.append("(?:")
        elif part[0] in ")|":
            out.append(part)
        else:
            out.append(f" {'[^# ]+' if part == '*' else part}#[0-9]+ ")
    return "".join(out)
