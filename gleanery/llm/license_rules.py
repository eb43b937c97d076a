"""Signature rules of the license scan, in order of precedence within a priority.

A line is ``priority | label | keyword | pattern``.  Patterns run over words (lower case, no punctuation) with one space
between them; a keyword is a part of every text its pattern can match.  Priorities: 1 tags and license URLs, 2 names with
a version, 3 names, 4 fragments of license texts, 5 hints.
"""

SIGNATURES = """
1 | mit | spdx | spdx license identifier mit
1 | mit-0 | spdx | spdx license identifier mit 0
1 | apache-2.0 | spdx | spdx license identifier apache 2 0
1 | apache-1.1 | spdx | spdx license identifier apache 1 1
1 | bsd-2-clause | spdx | spdx license identifier bsd 2 clause
1 | bsd-3-clause | spdx | spdx license identifier bsd 3 clause
1 | bsd-4-clause | spdx | spdx license identifier bsd 4 clause
1 | 0bsd | spdx | spdx license identifier 0bsd
1 | isc | spdx | spdx license identifier isc
1 | gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
1 | gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
1 | lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
1 | lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
1 | agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
1 | mpl-2.0 | spdx | spdx license identifier mpl 2 0
1 | mpl-1.1 | spdx | spdx license identifier mpl 1 1
1 | epl-1.0 | spdx | spdx license identifier epl 1 0
1 | epl-2.0 | spdx | spdx license identifier epl 2 0
1 | cddl-1.0 | spdx | spdx license identifier cddl 1 0
1 | bsl-1.0 | spdx | spdx license identifier bsl 1 0
1 | zlib | spdx | spdx license identifier zlib
1 | unlicense | spdx | spdx license identifier unlicense
1 | wtfpl | spdx | spdx license identifier wtfpl
1 | cc0-1.0 | spdx | spdx license identifier cc0 1 0
1 | cc-by-4.0 | spdx | spdx license identifier cc by 4 0
1 | cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
1 | eupl-1.2 | spdx | spdx license identifier eupl 1 2
1 | artistic-2.0 | spdx | spdx license identifier artistic 2 0
1 | ofl-1.1 | spdx | spdx license identifier ofl 1 1
1 | python-2.0 | spdx | spdx license identifier (?:python|psf) 2 0
1 | mit | opensource | opensource org licenses? mit(?: license)?
1 | isc | opensource | opensource org licenses? isc(?: license)?
1 | apache-2.0 | opensource | opensource org licenses? apache 2 0
1 | bsd-2-clause | opensource | opensource org licenses? bsd 2 clause
1 | bsd-3-clause | opensource | opensource org licenses? bsd 3 clause
1 | mpl-2.0 | opensource | opensource org licenses? mpl 2 0
1 | gpl-2.0 | opensource | opensource org licenses? gpl 2 0
1 | gpl-3.0 | opensource | opensource org licenses? gpl 3 0
1 | lgpl-2.1 | opensource | opensource org licenses? lgpl 2 1
1 | lgpl-3.0 | opensource | opensource org licenses? lgpl 3 0
1 | agpl-3.0 | opensource | opensource org licenses? agpl 3 0
1 | zlib | opensource | opensource org licenses? zlib
1 | ecl-2.0 | opensource | opensource org licenses? ecl 2 0
1 | apache-2.0 | apache | (?:www )?apache org licenses license 2 0(?: html| txt)?
1 | apache-1.1 | apache | (?:www )?apache org licenses license 1 1
1 | gpl-2.0 | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
1 | gpl-3.0 | gnu | (?:www )?gnu org licenses gpl(?: 3 0)?(?: html| txt)?
1 | lgpl-2.1 | gnu | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
1 | lgpl-3.0 | gnu | (?:www )?gnu org licenses lgpl(?: 3 0)?(?: html| txt)?
1 | agpl-3.0 | gnu | (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
1 | gfdl-1.3 | gnu | (?:www )?gnu org licenses fdl(?: 1 3)?(?: html| txt)?
1 | mpl-2.0 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
1 | mpl-1.1 | mozilla | (?:www )?mozilla org mpl mpl 1 1
1 | epl-1.0 | eclipse | (?:www )?eclipse org legal epl v10(?: html)?
1 | epl-2.0 | eclipse | (?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
1 | unlicense | unlicense | unlicense org
1 | wtfpl | wtfpl | (?:www |sam zoy org )wtfpl(?: net)?
1 | bsl-1.0 | boost | (?:www )?boost org license 1 0 txt
1 | ofl-1.1 | sil | scripts sil org ofl
1 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
1 | pdm-1.0 | creativecommons | creativecommons org publicdomain mark 1 0
1 | cc-by-1.0 | creativecommons | creativecommons org licenses by 1 0
1 | cc-by-2.0 | creativecommons | creativecommons org licenses by 2 0
1 | cc-by-2.5 | creativecommons | creativecommons org licenses by 2 5
1 | cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
1 | cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
1 | cc-by-sa-2.0 | creativecommons | creativecommons org licenses by sa 2 0
1 | cc-by-sa-2.5 | creativecommons | creativecommons org licenses by sa 2 5
1 | cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
1 | cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
1 | cc-by-nc-2.0 | creativecommons | creativecommons org licenses by nc 2 0
1 | cc-by-nc-3.0 | creativecommons | creativecommons org licenses by nc 3 0
1 | cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
1 | cc-by-nd-3.0 | creativecommons | creativecommons org licenses by nd 3 0
1 | cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
1 | cc-by-nc-sa-3.0 | creativecommons | creativecommons org licenses by nc sa 3 0
1 | cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
1 | cc-by-nc-nd-3.0 | creativecommons | creativecommons org licenses by nc nd 3 0
1 | cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
2 | cc-by-2.0 | cc | cc by 2 0
2 | cc-by-2.5 | cc | cc by 2 5
2 | cc-by-3.0 | cc | cc by 3 0
2 | cc-by-4.0 | cc | cc by 4 0
2 | cc-by-sa-2.0 | cc | cc by sa 2 0
2 | cc-by-sa-2.5 | cc | cc by sa 2 5
2 | cc-by-sa-3.0 | cc | cc by sa 3 0
2 | cc-by-sa-4.0 | cc | cc by sa 4 0
2 | cc-by-nc-3.0 | cc | cc by nc 3 0
2 | cc-by-nc-4.0 | cc | cc by nc 4 0
2 | cc-by-nd-4.0 | cc | cc by nd 4 0
2 | cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
2 | cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
2 | cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
3 | cc-by-sa | cc | cc by sa
3 | cc-by-nc | cc | cc by nc
3 | cc-by-nd | cc | cc by nd
3 | cc-by-nc-sa | cc | cc by nc sa
3 | cc-by-nc-nd | cc | cc by nc nd
3 | cc0-1.0 | cc0 | cc0(?: 1 0)?
2 | cc-by-4.0 | creative | creative commons attribution 4 0(?: international)?(?: licen[cs]e)?
2 | cc-by-3.0 | creative | creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
2 | cc-by-sa-4.0 | creative | creative commons attribution share ?alike 4 0(?: international)?(?: licen[cs]e)?
2 | cc-by-sa-3.0 | creative | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?
2 | cc-by-nc-4.0 | creative | creative commons attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?
2 | cc-by-nc-3.0 | creative | creative commons attribution non ?commercial 3 0(?: unported)?(?: licen[cs]e)?
2 | cc-by-nd-4.0 | creative | creative commons attribution no ?deriv(?:atives|s) 4 0(?: international)?
2 | cc-by-nc-sa-4.0 | creative | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
2 | cc-by-nc-nd-4.0 | creative | creative commons attribution non ?commercial no ?deriv(?:atives|s) 4 0(?: international)?
3 | cc-by | creative | creative commons attribution(?: licen[cs]e)?
3 | cc-by-sa | creative | creative commons attribution share ?alike(?: licen[cs]e)?
3 | cc-by-nc | creative | creative commons attribution non ?commercial(?: licen[cs]e)?
3 | cc-by-nd | creative | creative commons attribution no ?deriv(?:atives|s)(?: licen[cs]e)?
3 | cc0-1.0 | creative | creative commons (?:zero|public domain dedication)
5 | creative-commons | creative | creative commons
3 | mit | mit | (?:the )?mit licen[cs]e
3 | mit | expat | (?:the )?expat licen[cs]e
3 | mit | mit | mit style licen[cs]e
3 | mit | mit | licensed under (?:the )?(?:terms of the )?mit
3 | mit | mit | (?:released|distributed|published|available) under (?:the )?(?:terms of the )?mit(?: licen[cs]e)?
4 | mit | permission | permission is hereby granted free of charge to any person obtaining a copy
4 | mit | copyright | the above copyright notice and this permission notice shall be included in all
4 | isc | permission | permission to use copy modify and or distribute this software for any purpose
4 | isc | permission | permission to use copy modify and distribute this software for any purpose
3 | isc | isc | (?:the )?isc licen[cs]e
3 | x11 | x11 | (?:the )?x11 licen[cs]e
2 | apache-2.0 | apache | (?:the )?apache licen[cs]e(?: version)? 2(?: 0)?
2 | apache-2.0 | apache | apache (?:software )?licen[cs]e v2(?: 0)?
2 | apache-2.0 | apache | apache 2(?: 0)? licen[cs]e
2 | apache-2.0 | apache | (?:released|distributed|licensed|available) under (?:the )?apache(?: licen[cs]e)?(?: version)? 2(?: 0)?
2 | apache-1.1 | apache | (?:the )?apache (?:software )?licen[cs]e(?: version)? 1 1
2 | apache-1.0 | apache | (?:the )?apache (?:software )?licen[cs]e(?: version)? 1 0
3 | apache | apache | (?:the )?apache (?:software )?licen[cs]e
4 | apache-2.0 | compliance | you may not use this file except in compliance with the licen[cs]e
4 | apache-2.0 | warranties | distributed on an as is basis without warranties or conditions of any kind
2 | bsd-2-clause | bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
2 | bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
2 | bsd-4-clause | bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?
2 | 0bsd | bsd | (?:zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[cs]e)?
3 | 0bsd | 0bsd | 0bsd
3 | bsd | bsd | (?:the )?bsd(?: style)? licen[cs]e
3 | bsd | bsd | (?:released|distributed|licensed|available) under (?:the )?bsd(?: licen[cs]e)?
4 | bsd | redistribut | redistribution and use in source and binary forms with or without modification are permitted
4 | bsd | redistribut | redistributions of source code must retain the above copyright notice
4 | bsd | redistribut | redistributions in binary form must reproduce the above copyright notice
4 | bsd-3-clause | endorse | (?:may|to) be used to endorse or promote products derived from this software
4 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
2 | gpl-1.0 | general | (?:gnu )?general public licen[cs]e(?: version| v)? 1(?: 0)?
2 | gpl-2.0 | general | (?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)?
2 | gpl-3.0 | general | (?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)?
2 | lgpl-2.0 | general | (?:gnu )?library general public licen[cs]e(?: version| v)? 2(?: 0)?
2 | lgpl-2.1 | general | (?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1
2 | lgpl-3.0 | general | (?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)?
2 | agpl-3.0 | general | (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?
2 | gpl-2.0 | gpl | (?:gnu )?gpl ?v ?2(?: 0)?
2 | gpl-3.0 | gpl | (?:gnu )?gpl ?v ?3(?: 0)?
2 | gpl-2.0 | gpl | (?:gnu )?gpl (?:version )?2(?: 0)?(?: only| or later)?
2 | gpl-3.0 | gpl | (?:gnu )?gpl (?:version )?3(?: 0)?(?: only| or later)?
2 | lgpl-2.1 | lgpl | lgpl(?: v| version)? 2 1(?: only| or later)?
2 | lgpl-2.1 | lgpl | lgplv2 1
2 | lgpl-3.0 | lgpl | (?:lgplv3|lgpl(?: v| version)? 3)(?: 0)?
2 | agpl-3.0 | agpl | (?:agplv3|agpl(?: v| version)? 3)(?: 0)?
3 | gpl | general | gnu general public licen[cs]e
3 | lgpl | general | (?:gnu )?(?:lesser|library) general public licen[cs]e
3 | agpl | general | (?:gnu )?affero general public licen[cs]e
3 | gpl | gpl | (?:gnu |the )?gpl(?: licen[cs]e)?
3 | lgpl | lgpl | (?:gnu |the )?lgpl(?: licen[cs]e)?
3 | agpl | agpl | (?:gnu |the )?agpl(?: licen[cs]e)?
3 | gfdl | free | (?:gnu )?free documentation licen[cs]e
2 | gfdl-1.2 | free | (?:gnu )?free documentation licen[cs]e version 1 2
2 | gfdl-1.3 | free | (?:gnu )?free documentation licen[cs]e version 1 3
4 | gpl | redistribut | you can redistribute it and or modify it under the terms of the gnu
4 | gpl | redistribut | this program is free software you can redistribute it
4 | gpl | warranty | without even the implied warranty of merchantability or fitness for a particular purpose
4 | gpl | general | you should have received a copy of the gnu general public licen[cs]e
4 | lgpl | general | you should have received a copy of the gnu lesser general public licen[cs]e
4 | gpl-or-later | option | (?:either version [0-9]+ of the licen[cs]e or )?at your option any later version
2 | mpl-1.0 | mozilla | mozilla public licen[cs]e(?: version| v)? 1 0
2 | mpl-1.1 | mozilla | mozilla public licen[cs]e(?: version| v)? 1 1
2 | mpl-2.0 | mozilla | mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
3 | mpl | mozilla | mozilla public licen[cs]e
2 | mpl-2.0 | mpl | mpl(?: v| version)? ?2(?: 0)?
4 | mpl-2.0 | subject | this source code form is subject to the terms of the mozilla public licen[cs]e
2 | epl-1.0 | eclipse | eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
2 | epl-2.0 | eclipse | eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
3 | epl | eclipse | eclipse public licen[cs]e
3 | edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: v| version)?(?: 1 0)?
2 | cpl-1.0 | common | common public licen[cs]e(?: version| v)?(?: 1 0)?
2 | cddl-1.0 | common | common development and distribution licen[cs]e(?: version)?(?: 1 0)?
2 | cddl-1.1 | common | common development and distribution licen[cs]e version 1 1
3 | cddl | cddl | cddl(?: licen[cs]e)?
2 | cpal-1.0 | common | common public attribution licen[cs]e(?: version)?(?: 1 0)?
2 | eupl-1.1 | european | european union public licen[cs]e(?: version| v)? 1 1
2 | eupl-1.2 | european | european union public licen[cs]e(?: version| v)? 1 2
3 | eupl | european | european union public licen[cs]e
3 | eupl | eupl | eupl(?: v ?1 [12])?
2 | bsl-1.0 | boost | boost software licen[cs]e(?: version)?(?: 1 0)?
2 | busl-1.1 | business | business source licen[cs]e(?: version)?(?: 1 1)?
2 | sspl-1.0 | server | server side public licen[cs]e(?: version| v)?(?: 1)?
3 | sspl-1.0 | sspl | sspl(?: v1)?
2 | elastic-2.0 | elastic | elastic licen[cs]e(?: version)? 2 0
3 | elastic | elastic | elastic licen[cs]e
3 | zlib | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
4 | zlib | warranty | provided as is without any express or implied warranty in no event will the authors
3 | libpng | libpng | libpng licen[cs]e
3 | openssl | openssl | openssl licen[cs]e
3 | ssleay | ssleay | ssleay licen[cs]e
3 | curl | curl | curl licen[cs]e
3 | php-3.01 | php | php licen[cs]e(?: version)?(?: 3 01)?
3 | python-2.0 | python | python software foundation licen[cs]e(?: version 2)?
3 | psf-2.0 | psf | psf licen[cs]e(?: agreement)?
3 | ruby | ruby | ruby licen[cs]e
3 | perl | perl | (?:same terms as|licensed as) perl(?: itself)?
2 | artistic-1.0 | artistic | artistic licen[cs]e(?: version)? 1 0
2 | artistic-2.0 | artistic | artistic licen[cs]e(?: version)? 2 0
3 | artistic | artistic | (?:the )?artistic licen[cs]e
3 | postgresql | postgresql | postgresql licen[cs]e
3 | ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e
3 | upl-1.0 | universal | universal permissive licen[cs]e(?: v 1 0)?
3 | afl-3.0 | academic | academic free licen[cs]e(?: version)?(?: 3 0| v 3 0)?
3 | osl-3.0 | open | open software licen[cs]e(?: version)?(?: 3 0| v 3 0)?
3 | ms-pl | microsoft | microsoft public licen[cs]e
3 | ms-rl | microsoft | microsoft reciprocal licen[cs]e
3 | wtfpl | wtfpl | wtfpl
3 | unlicense | unlicense | (?:the )?unlicense
4 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
3 | beerware | beer | beer ?ware licen[cs]e
3 | ofl-1.1 | sil | sil open font licen[cs]e(?: version)?(?: 1 1)?
3 | ofl | font | open font licen[cs]e
3 | odbl-1.0 | database | open (?:data commons )?(?:open )?database licen[cs]e(?: v1 0)?
3 | odc-by-1.0 | commons | open data commons attribution licen[cs]e(?: v1 0)?
3 | pddl-1.0 | commons | open data commons public domain dedication and licen[cs]e
3 | ogl-uk-3.0 | government | open government licen[cs]e(?: v3 0| version 3 0)?
3 | openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m| licen[cs]e)?
3 | public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
4 | public-domain | domain | (?:is|are) in the public domain
5 | public-domain | domain | public domain
3 | proprietary | proprietary | proprietary and confidential
3 | proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) (?:of this file |of this document |via any medium )?is strictly prohibited
4 | proprietary | permission | (?:no part of|not to be) (?:this (?:publication|document|work) may be )?reproduced without (?:prior )?(?:written )?permission
4 | proprietary | licensed | licensed not sold
3 | trade-secret | trade | trade secrets? of
4 | non-commercial | commercial | (?:for )?non ?commercial (?:use|purposes) only
4 | non-commercial | commercial | not for commercial (?:use|purposes)
4 | no-derivatives | derivative | no derivative works? (?:may be|are) (?:made|permitted|allowed)
4 | research-only | research | for research (?:use|purposes) only
4 | educational | educational | for educational (?:use|purposes) only
4 | no-warranty | warrant | without warrant(?:y|ies) of any kind
4 | no-warranty | warrant | as is without warrant(?:y|ies)
4 | no-liability | liable | in no event shall the (?:authors?|copyright holders?|contributors?)(?: or copyright holders)? be liable
5 | reserved | reserved | some rights reserved
5 | copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
5 | copyright | copyright | (?:is|are) (?:protected by )?copyright
5 | copyright | copyright | copyrighted (?:material|work|content)
5 | copyright | copyright | copyright holders?
5 | copyright | copyright | copyright (?:by|of) [a-z]+
5 | trademark | trademark | (?:registered )?trademarks? of
5 | license | licen | licen[cs]ed under (?:the )?(?:terms of )?(?:the )?[a-z0-9]+
5 | license | licen | (?:under|see) the licen[cs]e
5 | license | licen | (?:see|read) (?:the )?licen[cs]e (?:file|txt|md|for details)
5 | license | licen | terms of (?:the|this) licen[cs]e
5 | license | licen | licen[cs]e agreement
5 | license | licen | (?:released|distributed|published) under (?:a|an|the) [a-z0-9]+ licen[cs]e
5 | terms-of-use | terms | terms (?:of|and conditions of) (?:use|service)
""".strip()


def signatures() -> list[tuple[int, int, str, str, str]]:
    """(number, priority, label, keyword, pattern) in order."""
    out = []
    for n, line in enumerate(SIGNATURES.splitlines()):
        p, label, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append((n, int(p), label, keyword, pattern))
    return out
