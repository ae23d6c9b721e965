"""Literal feeds for unit tests (see FIXTURES.md)."""

# FIXED VALUES: the feeds' column names, which the data model gives (rows are our own).
US_FEED = """transaction_id,card_number,merchant_name,amount_usd,transaction_time,status,is_international
U1,4000000000000001,"Smith, Lee and Co",10.50,2026-01-01 10:00:00,APPROVED,0
U2,4000000000000002,Acme,,2026-01-01 10:01:00,DECLINED,1
U3,4000000000000003,Acme,50000,2026-01-01 10:02:00,PENDING,0
U4,4000000000000004,Acme,12,2026-01-01 10:03:00,UNKNOWN_STATUS,0
,4000000000000005,Acme,12,2026-01-01 10:04:00,UNKNOWN_STATUS,0
U6,4000000000000006,Acme,abc,2026-01-01 10:05:00,APPROVED,0
U1,4000000000000001,"Smith, Lee and Co",11.00,2026-01-01 10:06:00,APPROVED,0
"""

IN_FEED = """txn_ref,card_id,vendor,amount_inr,txn_datetime,txn_status,upi_flag
I1,C1,Vendor A,1000,01/01/2026 09:05,success,Y
I2,,Vendor B,2500.50,01/01/2026 10:10,failed,N
I3,C3,Vendor C,-5,01/01/2026 11:15,pending,Y
"""

MERCHANT_FEED = """merchant_id,business_name,merchant_category,country_code,city,risk_tier,onboarded_date,is_active
M1,"Shop, One",Retail,US,New York,LOW,2020-01-15,1
M2,Shop Two,,IN,Mumbai,HIGH,2021-03-01,1
M3,Shop Three,Food,INVALID,Singapore,MEDIUM,2019-07-30,0
"""

ATM_FEED = """withdrawal_id,atm_id,card_hash,amount_sgd,currency,withdrawal_ts,dispense_status,location
W1,ATM1,0123456789abcdef,100,SGD,2026-01-01T10:00:00.123456,DISPENSED,"Orchard, Singapore"
W2,ATM2,0123456789abcdef,75,SGD,2026-01-01T11:00:00,DISPENSED,Jurong
W3,ATM3,0123456789abcdef,50,SGD,2026-01-01T12:00:00.5,FAILED,Changi
"""

FRAUD_FEED = """flag_id,transaction_ref,fraud_score,flag_type,flagged_at,reviewed
F1,U1,0.91,VELOCITY,2026-01-01T10:30:00.250000,0
F2,U1,0.55,GEO_ANOMALY,2026-01-01T11:00:00,1
F3,U999,0.4,AMOUNT_SPIKE,2026-01-01T12:00:00,0
F4,,0.7,NEW_MERCHANT,2026-01-01T13:00:00,0
"""

# FIXED VALUES: the three rows that the mutation sequence loads.
EMP_CSV = "101,ALICE,Data Engineering,75000.0\n102,BOB,Analytics,68000.0\n103,CHARLIE,Operations,55000.0\n"


def write_feed(root: str, source_dir: str, date: str, name: str, text: str) -> str:
    import os

    d = os.path.join(root, "raw", source_dir, f"processing_date={date}")
    os.makedirs(d, exist_ok=True)
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p
