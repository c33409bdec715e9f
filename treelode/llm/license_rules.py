"""Signature rules for licenses: one line each, as `kind | label | keyword | regular expression`.

Expressions match normalised text: words of letters, digits and non-ASCII characters in lower case, one space between them. They begin
and end at words. A keyword is a string that every match of the expression contains; `=` stands for the expression itself.
"""
from __future__ import annotations

#: Priority (lower wins) and confidence of each kind: wording of a license's own text, a tag, a grant, a name with its version, a name
#: without, a hint that some license is meant.
KINDS = {"text": (0, 1.0), "tag": (1, 0.99), "grant": (2, 0.95), "name": (3, 0.8), "family": (4, 0.5), "hint": (5, 0.2)}

#: Phrases and labels of the base; they always stay.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

HAND_WRITTEN = r"""
text | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text | mit | to deal in the software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
text | mit | above copyright notice and this permission notice | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions
text | mit-0 | to deal in the software without restriction | permission is hereby granted free of charge (?:[^ ]+ ){10,20}to deal in the software without restriction (?:[^ ]+ ){20,40}the software is provided as is
text | x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used
text | isc | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
text | 0bsd | fee is hereby granted the software is provided as is | with or without fee is hereby granted the software is provided as is
text | bsd-2-clause | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text | bsd-2-clause | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice
text | bsd-3-clause | may be used to endorse or promote | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote
text | bsd-4-clause | must display the following acknowledg | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
text | bsd-3-clause-clear | no express or implied licenses to any party | no express or implied licenses to any party s patent rights are granted by this license
text | apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
text | apache-2.0 | you may not use this file except in compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at
text | apache-2.0 | terms and conditions for use reproduction and distribution | terms and conditions for use reproduction and distribution 1 definitions
text | apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
text | gpl | free software foundation either version | under the terms of the gnu general public license as published by the free software foundation either version
text | gpl-1.0+ | either version 1 of the license | gnu general public license as published by the free software foundation either version 1 of the license
text | gpl-2.0+ | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
text | gpl-3.0+ | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
text | gpl-2.0 | general public license version 2 as published | gnu general public license version 2 as published by the free software foundation
text | gpl | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
text | gpl | the licenses for most software | the licenses for most software are designed to take away your freedom to share and change it
text | gpl-3.0 | free copyleft license for software | the gnu general public license is a free copyleft license for software and other kinds of works
text | lgpl-2.1+ | either version 2 1 of the license | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
text | lgpl-2.0+ | gnu library general public license | gnu library general public license as published by the free software foundation either version 2 of the license
text | lgpl-3.0+ | gnu lesser general public license | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
text | lgpl | see the gnu lesser general public license | fitness for a particular purpose see the gnu lesser general public license for more details
text | agpl-3.0+ | gnu affero general public license | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
text | agpl | see the gnu affero general public license | fitness for a particular purpose see the gnu affero general public license for more details
text | gfdl | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
text | gfdl | no invariant sections | with no invariant sections no front cover texts and no back cover texts
text | mpl-2.0 | mozilla public license v 2 0 | this source code form is subject to the terms of the mozilla public license v 2 0
text | mpl-1.1 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
text | mpl-1.0 | mozilla public license version 1 0 | the contents of this file are subject to the mozilla public license version 1 0
text | npl-1.1 | netscape public license | the contents of this file are subject to the netscape public license
text | cddl-1.0 | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
text | epl-2.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0
text | epl-1.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0
text | cpl-1.0 | common public license | the accompanying program is provided under the terms of this common public license
text | unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
text | unlicense | anyone is free to copy modify publish | anyone is free to copy modify publish use compile sell or distribute this software
text | wtfpl | you just do what the | you just do what the [^ ]+ you want to
text | zlib | origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
text | zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
text | bsl-1.0 | covered by this license | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
text | artistic-1.0 | the intent of this document | the intent of this document is to state the conditions under which a package may be copied
text | artistic-2.0 | everyone is permitted to copy | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes
text | python-2.0 | python software foundation | this license agreement is between the python software foundation
text | ofl-1.1 | sil open font license | this font software is licensed under the sil open font license version 1 1
text | ofl-1.1 | reserved font name | no modified version of the font software may use the reserved font name
text | cc0-1.0 | commons deed is not a legal instrument | the commons deed is not a legal instrument
text | cc0-1.0 | has waived all copyright | has waived all copyright and related or neighboring rights
text | cc-by-4.0 | attribution 4 0 international public license | by exercising the licensed rights (?:[^ ]+ ){1,20}creative commons attribution 4 0 international public license
text | cc-by-sa-4.0 | attribution sharealike 4 0 international public license | by exercising the licensed rights (?:[^ ]+ ){1,20}creative commons attribution sharealike 4 0 international public license
text | openssl | openssl project for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
text | ssleay | cryptographic software written by eric young | this product includes cryptographic software written by eric young
text | json | shall be used for good not evil | the software shall be used for good not evil
text | beerware | buy me a beer | you can buy me a beer in return
text | ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
text | ncsa | documentation files the software to deal with the software | documentation files the software to deal with the software without restriction
text | php-3.01 | this product includes php software | this product includes php software freely available from
text | curl | permission to use copy modify and distribute this software for any purpose with or without fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
text | hpnd | appear in supporting documentation | both that copyright notice and this permission notice appear in supporting documentation
text | ms-pl | microsoft public license | this license governs use of the accompanying software if you use the software you accept this license (?:[^ ]+ ){0,20}microsoft public license
text | upl-1.0 | larger works | copy create derivative works of display perform and distribute the software and make use sell offer for sale import export have made and have sold the software and the larger works
text | busl-1.1 | production use of the licensed work | you to make non production use of the licensed work|the right to copy modify create derivative works redistribute and make non production use of the licensed work
text | sspl-1.0 | service source code | offering the software as a service (?:[^ ]+ ){0,20}service source code
text | elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
text | commons-clause | commons clause license condition | commons clause license condition
text | proprietary | confidential and proprietary | (?:is |are )?(?:strictly )?confidential and proprietary (?:information )?(?:of|to) [^ ]+
text | proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
text | llama-3 | llama | by using or distributing any portion or element of the llama materials|meta llama 3 community license agreement
grant | apache-2.0 | apache license | licensed under the apache license version 2(?: 0)?
grant | apache-2.0 | apache | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?
grant | apache | apache | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?apache(?: software)? license
grant | apache-2.0 | apache org licenses license 2 0 | www apache org licenses license 2 0
grant | mit | mit license | (?:released|licensed|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of the )?mit license
grant | mit | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php| html)?
grant | mit | mit | license (?:is )?mit
grant | gpl-3.0 | general public license | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license (?:version|v) 3(?: 0)?
grant | gpl-2.0 | general public license | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license (?:version|v) 2(?: 0)?
grant | gpl-3.0+ | any later version | gnu general public license (?:version|v) 3(?: 0)? or (?:at your option )?any later version
grant | gpl-2.0+ | any later version | gnu general public license (?:version|v) 2(?: 0)? or (?:at your option )?any later version
grant | gpl | general public license | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license
grant | gpl | gnu org licenses | gnu org licenses (?:old licenses )?gpl(?: [23] 0)?(?: html| txt)?
grant | lgpl | gnu org licenses | gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?(?: html| txt)?
grant | agpl | gnu org licenses | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
grant | lgpl | lesser general public license | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?lesser general public license
grant | agpl | affero general public license | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?affero general public license
grant | bsd | bsd | (?:released|licensed|distributed|available|published) under (?:the |a )?(?:terms of the )?(?:simplified |modified |new |revised )?bsd(?: style)? license
grant | bsd-style | bsd style license that can be found | governed by a bsd style license that can be found in the license file
grant | mpl-2.0 | mozilla org mpl 2 0 | mozilla org mpl 2 0
grant | epl | eclipse org legal epl | eclipse org legal epl (?:v10|v20|2 0)
grant | unlicense | unlicense org | unlicense org
grant | cc-by-4.0 | licensed under cc by 4 0 | licensed under cc by 4 0
grant | cc-by-nc-4.0 | cc by nc 4 | licensed under cc by nc 4(?: 0)?
grant | cc-by-sa-4.0 | cc by sa 4 | licensed under cc by sa 4(?: 0)?
grant | cc-by-nd-4.0 | cc by nd 4 | licensed under cc by nd 4(?: 0)?
grant | cc-by-nc-sa-4.0 | cc by nc sa 4 | licensed under cc by nc sa 4(?: 0)?
grant | cc-by-nc-nd-4.0 | cc by nc nd 4 | licensed under cc by nc nd 4(?: 0)?
grant | cc-by-3.0 | cc by 3 0 | licensed under cc by 3 0
grant | cc-by-sa-3.0 | cc by sa 3 0 | licensed under cc by sa 3 0
grant | cc-by-4.0 | creativecommons org licenses by 4 0 | creativecommons org licenses by 4 0
grant | cc-by-3.0 | creativecommons org licenses by 3 0 | creativecommons org licenses by 3 0
grant | cc-by-sa-4.0 | creativecommons org licenses by sa 4 0 | creativecommons org licenses by sa 4 0
grant | cc-by-sa-3.0 | creativecommons org licenses by sa 3 0 | creativecommons org licenses by sa 3 0
grant | cc-by-nc-4.0 | creativecommons org licenses by nc 4 0 | creativecommons org licenses by nc 4 0
grant | cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
grant | cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
grant | cc-by-nd-4.0 | creativecommons org licenses by nd 4 0 | creativecommons org licenses by nd 4 0
grant | cc0-1.0 | creativecommons org publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0
grant | cc-pdm-1.0 | creativecommons org publicdomain mark 1 0 | creativecommons org publicdomain mark 1 0
grant | cc-by | creative commons attribution | licensed under (?:a |the )?creative commons attribution(?: 4 0| 3 0)?(?: international| unported)?(?: license)?
grant | public-domain | public domain | (?:released|placed|dedicated|is|are) (?:in|into|to) the public domain
grant | proprietary | license agreement | use (?:of this software )?is subject to (?:the )?(?:terms of )?(?:the |a |your )?(?:commercial |end user )?license agreement
name | apache-2.0 | apache | apache(?: software)? license (?:version|v) ?2(?: 0)?
name | apache-2.0 | apache 2 0 | apache 2 0(?: license)?
name | apache-1.1 | apache | apache(?: software)? license (?:version |v ?)?1 1
name | apache-1.0 | apache | apache(?: software)? license (?:version |v ?)?1 0
name | gpl-3.0 | general public license | (?:gnu )?general public license (?:version |v ?)3(?: 0)?
name | gpl-2.0 | general public license | (?:gnu )?general public license (?:version |v ?)2(?: 0)?
name | gpl-1.0 | general public license | (?:gnu )?general public license (?:version |v ?)1(?: 0)?
name | gpl-3.0 | gpl | (?:gnu )?gpl ?v ?3(?: 0)?|gpl 3 0
name | gpl-2.0 | gpl | (?:gnu )?gpl ?v ?2(?: 0)?|gpl 2 0
name | lgpl-3.0 | lgpl | lgpl ?v ?3(?: 0)?|lgpl 3 0
name | lgpl-2.1 | lgpl | lgpl ?v ?2 1|lgpl 2 1
name | lgpl-2.0 | lgpl | lgpl ?v ?2 0|lgpl 2 0
name | agpl-3.0 | agpl | agpl ?v ?3(?: 0)?|agpl 3 0
name | lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)3(?: 0)?
name | lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)2 1
name | lgpl-2.0 | library general public license | (?:gnu )?library general public license (?:version |v ?)2(?: 0)?
name | agpl-3.0 | affero general public license | (?:gnu )?affero general public license (?:version |v ?)3(?: 0)?
name | agpl-1.0 | affero general public license | affero general public license (?:version |v ?)1(?: 0)?
name | gfdl-1.3 | free documentation license | (?:gnu )?free documentation license (?:version |v ?)1 3
name | gfdl-1.2 | free documentation license | (?:gnu )?free documentation license (?:version |v ?)1 2
name | gfdl-1.1 | free documentation license | (?:gnu )?free documentation license (?:version |v ?)1 1
name | mpl-2.0 | mozilla public license | mozilla public license (?:version |v ?)?2 0
name | mpl-1.1 | mozilla public license | mozilla public license (?:version |v ?)?1 1
name | mpl-2.0 | mpl | mpl (?:v ?)?2 0
name | epl-2.0 | eclipse public license | eclipse public license (?:version |v ?)?2 0
name | epl-1.0 | eclipse public license | eclipse public license (?:version |v ?)?1 0
name | cddl-1.1 | development and distribution license | common development and distribution license (?:version |v ?)?1 1
name | cddl-1.0 | development and distribution license | common development and distribution license (?:version |v ?)?1 0
name | eupl-1.2 | european union public licen | european union public licen[cs]e (?:version |v ?)?1 2
name | eupl-1.1 | european union public licen | european union public licen[cs]e (?:version |v ?)?1 1
name | artistic-2.0 | artistic license | artistic license (?:version |v ?)?2 0
name | artistic-1.0 | artistic license | artistic license (?:version |v ?)?1 0
name | bsd-2-clause | 2 clause bsd | 2 clause bsd(?: license)?
name | bsd-3-clause | 3 clause bsd | 3 clause bsd(?: license)?
name | bsd-4-clause | 4 clause bsd | 4 clause bsd(?: license)?
name | bsd-2-clause | bsd | (?:simplified bsd|freebsd|bsd 2 clause) license
name | bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause) license
name | bsd-4-clause | bsd | (?:original bsd|old bsd|bsd 4 clause) license
name | 0bsd | bsd | (?:zero clause bsd|0 clause bsd|bsd zero clause)(?: license)?
name | mit-0 | mit | mit no attribution(?: license)?
name | mit | expat license | expat license
name | bsl-1.0 | boost software license | boost software license(?: version)?(?: 1 0)?
name | ms-pl | microsoft public license | microsoft public license
name | ms-rl | microsoft reciprocal license | microsoft reciprocal license
name | osl-3.0 | open software license | open software license (?:version |v ?)?3 0
name | afl-3.0 | academic free license | academic free license (?:version |v ?)?3 0
name | afl-2.1 | academic free license | academic free license (?:version |v ?)?2 1
name | ofl-1.1 | open font license | (?:sil )?open font license (?:version |v ?)?1 1
name | odbl-1.0 | open database license | (?:open data commons )?open database license(?: version| v)?(?: 1 0)?
name | odc-by-1.0 | open data commons attribution | open data commons attribution license(?: version| v)?(?: 1 0)?
name | pddl-1.0 | public domain dedication and license | (?:open data commons )?public domain dedication and license
name | cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
name | cc0-1.0 | creative commons zero | creative commons zero(?: v1 0| 1 0)?
name | cc-by-4.0 | cc by 4 0 | =
name | cc-by-3.0 | cc by 3 0 | =
name | cc-by-2.5 | cc by 2 5 | =
name | cc-by-2.0 | cc by 2 0 | =
name | cc-by-sa-4.0 | cc by sa 4 0 | =
name | cc-by-sa-3.0 | cc by sa 3 0 | =
name | cc-by-sa-2.0 | cc by sa 2 0 | =
name | cc-by-nc-4.0 | cc by nc 4 | cc by nc 4(?: 0)?
name | cc-by-nc-3.0 | cc by nc 3 | cc by nc 3(?: 0)?
name | cc-by-nc-sa-4.0 | cc by nc sa 4 | cc by nc sa 4(?: 0)?
name | cc-by-nc-sa-3.0 | cc by nc sa 3 | cc by nc sa 3(?: 0)?
name | cc-by-nc-nd-4.0 | cc by nc nd 4 | cc by nc nd 4(?: 0)?
name | cc-by-nd-4.0 | cc by nd 4 | cc by nd 4(?: 0)?
name | cc-by-sa | attribution sharealike | creative commons attribution sharealike(?: [234] [05])?(?: international| unported)?(?: license)?
name | cc-by-nc | attribution noncommercial | creative commons attribution noncommercial(?: [234] [05])?(?: international| unported)?(?: license)?
name | cc-by-nd | attribution noderiv | creative commons attribution noderiv(?:s|atives)(?: [234] [05])?(?: international| unported)?(?: license)?
name | cc-by-nc-sa | attribution noncommercial sharealike | creative commons attribution noncommercial sharealike(?: [234] [05])?(?: international| unported)?(?: license)?
name | cc-by-nc-nd | attribution noncommercial noderiv | creative commons attribution noncommercial noderiv(?:s|atives)(?: [234] [05])?(?: international| unported)?(?: license)?
name | busl-1.1 | business source license | business source license(?: 1 1)?
name | sspl-1.0 | server side public license | server side public license(?: v ?1)?
name | elastic-2.0 | elastic license | elastic license (?:v ?)?2(?: 0)?
name | rail | rail m | (?:open )?rail m
name | rail | responsible ai license | (?:open |creativeml open )?responsible ai license
name | openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?
family | gpl | general public license | =
family | gpl | gpl | =
family | lgpl | lgpl | =
family | lgpl | lesser general public license | =
family | agpl | agpl | =
family | agpl | affero general public license | =
family | apache | apache software license | =
family | mit | mit licen | mit licen[cs]ed?
family | bsd | bsd licen | bsd licen[cs]ed?
family | isc | isc license | =
family | mpl | mozilla public license | =
family | epl | eclipse public license | =
family | cddl | development and distribution license | (?:common )?development and distribution license
family | artistic | artistic license | =
family | zlib | zlib | zlib license|zlib libpng license
family | ofl | open font license | (?:sil )?open font license
family | gfdl | free documentation license | (?:gnu )?free documentation license
family | wtfpl | wtfpl | =
family | unlicense | unlicense | (?:the )?unlicense
family | psf | python software foundation license | =
family | php | php license | =
family | ruby | ruby license | =
family | cc-by | creative commons attribution | creative commons attribution(?: license)?
family | cc | creative commons license | =
family | cc-by-sa | cc by sa | =
family | cc-by-nc | cc by nc | =
family | cc-by-nd | cc by nd | =
family | public-domain | public domain | =
family | proprietary | proprietary license | =
family | proprietary | end user license agreement | =
family | commercial | commercial license | =
hint | copyleft | copyleft | =
hint | all-rights-reserved | all rights reserved | =
hint | open-source | open source licen | (?:an? )?open source licen[cs]e
hint | see-license | see license | see license(?: file)? (?:for|in)(?: [^ ]+){0,3}
hint | see-license | license file | (?:in|see) the (?:accompanying )?license file
hint | copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*
"""

#: Identifiers of tags such as `SPDX-License-Identifier: MIT`.
TAGGED = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause
BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-only GPL-3.0-or-later HPND ISC JSON LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 MIT
MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby SSPL-1.0 Unlicense
UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"""


def rule_lines() -> list[tuple[str, str, str, str]]:
    """(kind, label, keyword, expression) in the order that decides between equals."""
    lines = [tuple(part.strip() for part in line.split(" | ")) for line in HAND_WRITTEN.strip().splitlines()]
    rules = [(kind, label, keyword, keyword if pattern == "=" else pattern) for kind, label, keyword, pattern in lines]
    for name in TAGGED.split():
        label = name.lower().replace("-or-later", "+").replace("-only", "")
        words = name.lower().replace("-", " ").replace(".", " ")
        rules.append(("tag", label, "spdx license identifier", f"spdx license identifier {words}(?! [0-9]| only| or later)"))
    return rules
