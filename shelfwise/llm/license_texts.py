"""Wordings of license notices and opening paragraphs (fixed values)."""

from __future__ import annotations

from collections.abc import Iterator

#: (license, wording) of notices and paragraphs that stand for themselves.
PARAGRAPHS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CDDL-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'),
    ("CDDL-1.0", "Common Development and Distribution License (CDDL) Version 1.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"),
    ("EUPL-1.1", "Licensed under the EUPL, Version 1.1"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The MIT License (MIT)"),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS"'),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("PSF-2.0", 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("proprietary", "All rights reserved."),
)

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISING = " All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_ENDORSING = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = (
    ("GPL-1.0", "GNU General Public License", "1"),
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.0", "GNU Library General Public License", "2"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
)
_FREE_DOCUMENTATION = ("1.1", "1.2", "1.3")
_CC = (
    ("BY", ("Attribution",)),
    ("BY-SA", ("Attribution-ShareAlike", "Attribution-Share Alike")),
    ("BY-NC", ("Attribution-NonCommercial", "Attribution-Non-Commercial")),
    ("BY-ND", ("Attribution-NoDerivatives", "Attribution-NoDerivs", "Attribution-No Derivative Works")),
    ("BY-NC-SA", ("Attribution-NonCommercial-ShareAlike", "Attribution-Noncommercial-Share Alike")),
    ("BY-NC-ND", ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs", "Attribution-Noncommercial-No Derivative Works")),
)
_CC_VERSIONS = (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic"))
#: Names that follow "licensed under" and the like.
_NAMES = (
    ("Apache-2.0", ("Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License 2.0")),
    ("BSD", ("BSD License", "BSD-style License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause License", "Simplified BSD License", "FreeBSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause License", "New BSD License", "Modified BSD License")),
    ("BSL-1.0", ("Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License")),
    ("CC0-1.0", ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")),
    ("EPL-1.0", ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0")),
    ("ISC", ("ISC License",)),
    ("MIT", ("MIT License", "MIT/X11 License", "Expat License")),
    ("MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0")),
    ("Unlicense", ("Unlicense", "The Unlicense")),
    ("WTFPL", ("WTFPL",)),
    ("Zlib", ("zlib License", "zlib/libpng License")),
)
_VERBS = ("Licensed", "Released", "Distributed", "Available", "Published", "Provided")
_SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear "
    "BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CPL-1.0 "
    "ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later "
    "HPND ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL "
    "MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby UPL-1.0 Unlicense Vim W3C WTFPL X11 ZPL-2.1 Zlib"
).split()


def _under(name: str, wordings: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    for wording in wordings:
        for verb in _VERBS:
            for link in ("under", "under the", "under a", "under the terms of the"):
                yield name, f"{verb} {link} {wording}"


def _all() -> Iterator[tuple[str, str]]:
    yield from PARAGRAPHS
    yield "BSD-2-Clause", _BSD
    yield "BSD-3-Clause", _BSD + _ENDORSING
    yield "BSD-4-Clause", _BSD + _ADVERTISING
    for name, title, version in _GNU:
        yield name, f"This work is licensed under the {title}, version {version}."
        terms = f"This program is free software; you can redistribute it and/or modify it under the terms of the {title}"
        yield name, f"{terms} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
        yield name, f"{terms} as published by the Free Software Foundation; version {version} of the License."
        yield name, f"{terms}, version {version}, as published by the Free Software Foundation."
        yield name, f"{terms}, version {version}."
        short = name.split("-")[0]
        forms = [f"{title}, version {version}", f"{title} v{version}", f"{short} version {version}", f"{short} v{version}", f"{short}v{version}", f"{short}-{version}"]
        if "." not in version:
            forms += [f"{title} v{version}.0", f"{title} {version}.0", f"{title}, version {version}.0", f"{short} {version}.0", f"{short}-{version}.0"]
        yield from _under(name, tuple(forms))
    for version in _FREE_DOCUMENTATION:
        yield f"GFDL-{version}", f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {version} or any later version published by the Free Software Foundation"
    for code, titles in _CC:
        for version, kind in _CC_VERSIONS:
            name = f"CC-{code}-{version}"
            yield name, f"Licensed under CC {code} {version}."
            yield from _under(name, (f"CC {code} {version}", f"CC-{code} {version}", f"CC-{code}-{version}"))
            for title in titles:
                yield name, f"This work is licensed under a Creative Commons {title} {version} {kind} License."
                yield name, f"Creative Commons {title} {version} {kind} License"
                yield name, f"Creative Commons {title} {version}"
                yield name, f"Creative Commons {title} License {version}"
    for name, wordings in _NAMES:
        yield from _under(name, wordings)
    for name in _SPDX:
        yield name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}"


#: (license, wording), each wording once.
TEMPLATES: tuple[tuple[str, str], ...] = tuple(dict((text, (name, text)) for name, text in reversed(list(_all()))).values())[::-1]
