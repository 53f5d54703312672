import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from flowrisk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "flowrisk-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


# Six sample flows in the engine's CSV layout.
SAMPLE = """timestamp,src_ip,dst_ip,src_port,dst_port,protocol,duration_ms,packets,bytes_sent,bytes_received,syn_count,rst_count,unique_dst_ports_60s,connections_60s,failed_connections_60s,label
2026-08-13T09:00:00Z,192.168.1.10,142.250.72.14,52001,443,TCP,1300,24,4200,38000,1,0,2,8,0,benign
2026-08-13T09:00:10Z,192.168.1.10,1.1.1.1,53010,53,UDP,45,2,90,180,0,0,1,4,0,benign
2026-08-13T09:01:00Z,10.0.0.55,192.168.1.10,41000,22,TCP,520,70,3500,1200,45,20,42,55,35,attack
2026-08-13T09:02:00Z,10.0.0.77,192.168.1.10,42000,3389,TCP,1200,50,6000,3000,28,16,1,34,28,attack
2026-08-13T09:03:00Z,10.0.0.99,192.168.1.10,43000,443,TCP,900,420,26000,8000,380,2,2,480,5,attack
2026-08-13T09:04:00Z,192.168.1.10,203.0.113.50,54000,4444,TCP,22000,1800,65000000,15000,4,0,1,3,0,attack
"""


@pytest.fixture
def sample(tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text("﻿" + SAMPLE, encoding="utf-8")
    return str(path)


def rows(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
