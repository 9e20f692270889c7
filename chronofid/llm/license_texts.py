"""Known licence texts, headers and notices (fixed values: public wording), and digests of the long texts."""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_TERMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ITEMS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
_BSD_TERMS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB_OPENING = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
_ZLIB_ITEMS = [
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "This notice may not be removed or altered from any source distribution.",
]

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_LINK = "\n\nFor more information, please refer to <http://unlicense.org>"


def _paragraphs(*parts: str) -> str:
    return "\n\n".join(parts)


def _listed(opening: str, items: list[str], marks: list[str], *closing: str) -> str:
    return _paragraphs(opening, *(f"{m}{item}" for m, item in zip(marks, items)), *closing)


_NUMBERED, _BULLETS = ["1. ", "2. ", "3. "], [""] * 3

#: Licence id, titles that may stand above the text, and the ways its body is written.
LICENSES: list[tuple[str, list[str], list[str]]] = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], [_MIT]),
    ("ISC", ["ISC License", "The ISC License", "ISC License (ISC)"], [
        _paragraphs(g + _ISC_KEEP + ".", _ISC_TERMS) for g in (_ISC_GRANT, _ISC_GRANT.replace("and/or", "and"))
    ]),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"], [_paragraphs(_ISC_GRANT + ".", _ISC_TERMS)]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"], [
        _listed(_BSD_OPENING, _BSD_ITEMS[:2], marks, _BSD_TERMS) for marks in (_NUMBERED, _BULLETS)
    ]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"], [
        _listed(_BSD_OPENING, _BSD_ITEMS, marks, _BSD_TERMS) for marks in (_NUMBERED, _BULLETS)
    ]),
    ("Zlib", ["zlib License", "The zlib License", "The zlib/libpng License"], [_listed(_ZLIB_OPENING, _ZLIB_ITEMS, marks) for marks in (_NUMBERED, _BULLETS)]),
    ("BSL-1.0", ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"], [_BOOST]),
    ("Unlicense", ["The Unlicense", "Unlicense"], [_UNLICENSE, _UNLICENSE + _UNLICENSE_LINK]),
]

_GNU = """{work} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{mark2} either version {version} of the License, or
(at your option) any later version."""

#: Licences that an SPDX line may name.
SPDX = [
    "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0",
    "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
]

#: Notices of one line, and headers of several lines that stand one below the other.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "This work is in the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *(
        (f"{short}-{version}", _GNU.format(work=work, kind=kind, version=version[:1] if version.endswith(".0") else version, mark=mark, mark2=mark2))
        for short, kind, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",)))
        for version in versions
        for work in ("This program", "This library")
        for mark, mark2 in ((":", ","), (";", ";"))
    ),
    *((name, f"SPDX-License-Identifier: {name}{suffix}") for name in SPDX for suffix in (("", "-only", "-or-later") if "GPL" in name else ("",))),
]

KNOWN = NOTICES + [
    (name, _paragraphs(*filter(None, (title, reserved, body))))
    for name, titles, bodies in LICENSES
    for title in ("", *titles)
    for reserved in ("", "All rights reserved.")
    for body in bodies
]

#: SHA-256 of the canonical form of whole texts too long to hold here, as their publishers print them.
DIGESTS = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "02a121bd244e30cfc02945b4ab6cd6889c41442a58d076deb3bd196c30c61806"),
    ("GFDL-1.3", "d2f6b83bca2ec722ccbe6ee61ccf9c409b4597182b2cbdfcbb086c74086abe33"),
    ("GPL-1.0", "596622575bcd3d827e7f6bce1f02e32bed2edeb0e9d8ce0d39441ba10031d1aa"),
    ("GPL-2.0", "632eed5ccd9536a119e4736f4111f5ea096d69650e17f4a3fcacb4d273e39aec"),
    ("GPL-3.0", "2ffd6d812c0507649bd9b76e37312b35de7967ad90057295a7b93a89198bbe9e"),
    ("LGPL-2.0", "87c83ddf13b8d772a493615bbfb7368fb6c87b179e064f6b4573dd9008cbd283"),
    ("LGPL-2.1", "4b7fd8442d92b28972b9aee4eb75166ac0ea6267095bdcdbe488d5f54b725b71"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "8b43f0ebc3e4d95bf2763eca63bbd86458f43d516345591663b1186d2d11e18e"),
]
