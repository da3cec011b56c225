"""Public licence texts and notices by SPDX name, and spellings that count as equal."""

_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n"
)
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

KNOWN = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY_ISC],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": [_BSD_2 + _WARRANTY_BSD, "BSD 2-Clause License\n" + _BSD_2 + _WARRANTY_BSD, "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [_BSD_2 + _BSD_3 + _WARRANTY_BSD, "BSD 3-Clause License\n" + _BSD_2 + _BSD_3 + _WARRANTY_BSD, "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC
    ],
    "MIT": [_MIT, "MIT License\n" + _MIT, "Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
    ],
}

EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("modification s", "modifications"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]

#: SHA-256 of the canonical form (see licenses.canonical) of whole licence texts.
FULL = {
    "Apache-2.0": ["0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"],
    "CC0-1.0": ["cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"],
    "GPL-1.0-only": ["9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"],
    "GPL-2.0-only": ["b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"],
    "GPL-3.0-only": ["59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349"],
    "LGPL-2.0-only": ["96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d"],
    "LGPL-2.1-only": ["22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e"],
    "LGPL-3.0-only": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["a038bead0535d9e18a762d7bfccdec8aa7d7de0963d959302b5426e7a35f821e"],
    "MPL-2.0": ["95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"],
}

#: Words of which each of these texts has one.
FULL_WORDS = ("affirmer", "apache", "gnu", "mozilla")
