"""Expected texts and inputs of the golden tests (fixed values)."""

# second of 2020-11-05 16:09, method, version, status, bytes
REPORT_INPUT = [
    (42, "GET", "1.1", 300, 3621),
    (43, "OPTIONS", "2.0", 300, 3811),
    (44, "OPTIONS", "2.0", 200, 3131),
    (45, "PUT", "1.1", 300, 273),
    (46, "HEAD", "2.0", 500, 1924),
    (47, "GET", "1.1", 200, 4036),
    (48, "PUT", "1.0", 300, 848),
    (49, "GET", "2.0", 500, 983),
    (50, "PUT", "1.1", 300, 3404),
    (51, "PUT", "1.0", 400, 745),
]
REPORT_LINES = [
    f'192.168.0.17 - lina [05/November/2020:16:09:{s} +0000] "{m} /wp-content/plugins/p{s} HTTP/{v}" {st} {b}'
    for s, m, v, st, b in REPORT_INPUT
]
REPORT = """\
General HTTP Traffic Statistics
===============================
Period: 10 seconds
From: 05/11/2020:16:09:42 +0000 (1604592582000)
To: 05/11/2020:16:09:51 +0000 (1604592591000)
Count: 10
Logs per second: 1.00
Count per section:
 - /wp-content: 10
Count per method:
 - PUT: 4
 - GET: 3
 - OPTIONS: 2
 - HEAD: 1
Count per version:
 - 2.0: 4
 - 1.1: 4
 - 1.0: 2
Count per status category:
 - Redirection: 5
 - Success: 2
 - ServerError: 2
 - ClientError: 1
Total received (POST, PUT): 5.15KB (527.00Bps)
Total sent (GET, HEAD, PATCH, OPTIONS, DELETE): 17.10KB (1.71KBps)
Total IO: 22.24KB (2.22KBps)
"""

# hits in the seconds from 2020-11-13 12:30:21
GAUGE_THRESHOLD = 7.4
GAUGE_HITS = [5, 10, 6, 2, 27, 4]
GAUGE_LINES = [
    f'127.0.0.1 - lina [13/11/2020:12:30:{21 + i} +0000] "GET /wp-content/{i}/{k} HTTP/1.1" 200 100'
    for i, hits in enumerate(GAUGE_HITS)
    for k in range(hits)
]
GAUGE_ALERTS = """\
High Traffic Gauge (7.40 req. per sec.): High Traffic - hits = {12}, avg: 7.50, triggered: {13/11/2020:12:30:22 +0000 (1605270622000)}
High Traffic Gauge (7.40 req. per sec.): Traffic is back to normal - hits = {21}, avg: 7.00, triggered: {13/11/2020:12:30:24 +0000 (1605270624000)}
High Traffic Gauge (7.40 req. per sec.): High Traffic - hits = {30}, avg: 10.00, triggered: {13/11/2020:12:30:25 +0000 (1605270625000)}
"""
