"""Alerts in the wordings that parsing must tell apart: payments of all kinds, hard and soft negatives, and texts that aren't payments.

In braces stand the amount (rs), four digits (l), a number (k) and a reference (ref) of the row that an alert is made of.
"""

WORDINGS = [
    # payments
    "Rs.{rs} has been debited from account **{l} to VPA shop{k}@icici SHOP {k} on 05-01-24. Your UPI transaction reference number is {ref}",
    "Your HDFC Bank Credit Card XX{l} has been used for a purchase of INR {rs} at SWIGGY{k} on 05-01-2024 at 14:32. Avl limit: INR 50,000.00",
    "Sent Rs.{rs} From HDFC Bank A/C x{l} To BIGBASKET On 05/01/24 Ref {ref}",
    "INR {rs} credited to your account XX{l} by UPI/CR/{ref}/AMIT KUMAR/YESB/amit{k}@ybl/Payment",
    "Refund of Rs {rs} processed and credited to your card ending {l} by Zepto",
    "Rs.{rs} was debited from a/c XX{l} to store{k}@okaxis (Meera Stores {k}) on 06-Jan-24 at 9:05 pm. UPI Ref No {ref}",
    "Dear customer, INR {rs} is debited from your account for Kirana Point (VPA: kp{k}@ybl) on 06/01/2024",
    "Avl bal: INR 9,876.50. You have paid Rs. {rs} to Corner Cafe Pvt Ltd on 07 Jan 2024 via UPI",
    "Spent Rs.{rs} On HDFC Bank Card {l} At DMART AVENUE On 2024-01-07:10:34:11",
    "Alert! Txn Amt:INR {rs} Dt:11/01/2024 Card XX{l} For METRO CASH Txn {ref}",
    "Rs.{rs} without OTP/PIN on card {l} at TOLL PLAZA {k} on 08-01-24",
    "Rs.{rs} debited earlier is back: reversal credited to your account XX{l}. Ref {ref}",
    "Your a/c XX{l} is debited with INR {rs}. Remarks: Rent for January ON time",
    "You have received Rs.{rs} from RAVI DAS PRIVATE LIMITED on 09-01-2024 at 18:45:10. Total balance: Rs. 1,00,000",
    "INR {rs} credited from ACME TECHNOLOGIES to a/c XX{l} by NEFT ref no {ref}N on 10-01-24",
    "Payment of Rs {rs} to City Gas received. Never share your card number or PIN. Ref no {ref}",
    "Rs 200 fee waived. Cash withdrawal: INR {rs} withdrawn at ATM MG ROAD on 10 Jan 24 at 11:15 am from card ending {l}",
    "Money sent: ₹{rs} transferred to Mrs Sunita Devi on 11-01-24 11:59. UPI txn id {ref}",
    "Rs.{rs} debited from account XX{l} to VPA q{k}@paytm lower case words on 12-01-24",
    "a/c XX{l} is debited for Rs {rs}. Info: P2M{ref} ref 12345678 towards shop9@upi",
    "Closing balance Rs 5,000. INR {rs} deposited in your account XX{l} on 31/12/2023 by cash. Outstanding Rs 20",
    "₹{rs} paid; you have paid to Book Barn Services Ltd, wallet txn no WAL{ref}",
    "Rs.{rs} spent at PYU*TEA STALL{k}; available limit: Rs.90,000. Seen on 45-13-24",
    "Rs {rs} was debited on 05-01-2019 12:00 towards M/s. Old Books at night. Never share an OTP with anyone",
    # hard negatives
    "Your OTP is {l} for the transaction of Rs.{rs}",
    "Your e-statement for account {l} is here: Rs.{rs} was debited",
    "Payment due: min amount due Rs.{rs} on card {l}",
    "A gentle reminder: Rs.{rs} was debited last month",
    "Rs.{rs} will be debited from account {l} on 05-01-24",
    "Reward points credited: 250 for Rs.{rs} spent at SHOP",
    "New limit: Rs.{rs} on your card {l}, spent at will",
    "SHOP {k} has requested Rs.{rs} to be debited from you",
    "Your transaction of Rs.{rs} on card {l} has failed",
    "Declined payment! Rs.{rs} spent at SHOP",
    "E-mandate created: Rs.{rs} is debited from account {l} monthly",
    "Our newsletter: customers spent at shops INR {rs}",
    "Convert your transaction of Rs.{rs} spent at SHOP into easy EMIs",
    # soft negatives
    "Get flat Rs. 200 cashback! Money received by thousands: INR {rs}",
    "Payment of Rs.{rs} made? Now upto 50% off",
    "You have received INR {rs}: an exclusive offer",
    "Payment sent Rs.{rs}, apply now for more",
    "You have paid Rs.{rs} to SHOP. Refer & earn",
    # neither
    "Your account was debited from the list of branches",
    "Rs.{rs} is the new price of plan {k}",
]


def pieces(wording: str) -> list[tuple[str, bool]]:
    """(text, whether it names a value) of a wording."""
    out = []
    for i, part in enumerate(wording.replace("}", "{").split("{")):
        if part:
            out.append((part, i % 2 == 1))
    return out
