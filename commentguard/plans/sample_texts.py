"""Sample comments with thread context, the texts given to event rows.

The generated tables hold no threats, slurs or direct attacks, so the comment
stream derived from ``events`` takes its texts from here.  Fixed values.
"""

# (text, context_type, parent_review_rating, perfection_pct, skip_pct)
SAMPLE_COMMENTS = [
    ("This movie is shit but the issue is pacing, not the actors personally.", "main_review", "Skip", 90.0, 5.0),
    ("@reviewer tu chutiya hai, review dena band kar.", "reply_to_review", "Skip", 90.0, 5.0),
    ("The script was weak.", "reply_to_review", "Skip", 90.0, 5.0),
    ("@user go die.", "reply_to_review", "Skip", 90.0, 5.0),
    ("waste of time. I like dc universe. Marvel is sh*t.", "main_review", "Skip", 30.0, 65.0),
    ("bc", "reply_to_review", "Skip", 30.0, 65.0),
    ("haa toh movie fiction hi hain, CINEMA IS SUBJECTIVE CHUTIYE", "reply_to_review", "Skip", 30.0, 65.0),
    ("@Nafis Jaka kaam khojo berojgar Bhadwa", "reply_to_review", "Skip", 30.0, 65.0),
    ("Toh mat dekh na laure rating kyu de rha hain agar jhaat bhar kuch samajh Nhi aaya", "reply_to_review", "Skip", 30.0, 65.0),
    ("tu m@d@rch0d hai", "reply_to_review", "Skip", 30.0, 65.0),
    ("ye kya b h a d w a comment hai", "reply_to_review", "Skip", 30.0, 65.0),
    ("l@wde jaake movie samajh", "reply_to_review", "Skip", 30.0, 65.0),
    ("chut!ye opinion mat de", "reply_to_review", "Skip", 30.0, 65.0),
    ("b#s#d#k review band kar", "reply_to_review", "Skip", 30.0, 65.0),
    ("@Nafis tu nalla hai", "reply_to_review", "Skip", 30.0, 65.0),
    ("tu chamar hai, review mat de", "reply_to_review", "Skip", 90.0, 5.0),
    ("arey chakka hai tu", "reply_to_review", "Skip", 90.0, 5.0),
    ("katua log yahan kya kar rahe hain", "reply_to_review", "Skip", 90.0, 5.0),
    ("pakistan chale jao tum log", "reply_to_review", "Skip", 90.0, 5.0),
    ("these people are subhuman vermin", "reply_to_review", "Skip", 90.0, 5.0),
    ("This movie beautifully depicts Hindu-Muslim unity during partition.", "main_review", "Skip", 90.0, 5.0),
    ("tu faggot hai", "reply_to_review", "Skip", 90.0, 5.0),
    ("You are shit", "reply_to_review", "Skip", 90.0, 5.0),
    ("plan b could work in this movie", "reply_to_review", "Timepass", 90.0, 5.0),
    ("your kindness is rare", "main_review", "Timepass", 90.0, 5.0),
    ("the ending hurt a lot, lovely film", "main_review", "Timepass", 90.0, 5.0),
    ("the weather is mild", "reply_to_review", "Skip", 90.0, 5.0),
    ("this chutiya movie wasted two hours", "main_review", "Timepass", 90.0, 5.0),
    ("Perfection dene wale log mand-buddhi hain.", "reply_to_review", "Perfection", 88.0, 6.0),
    ("You don't know history kiddo, but okay your opinion.", "reply_to_review", "Timepass", 76.0, 9.0),
    ("TMKC wala director hai yeh.", "main_review", "Skip", 90.0, 5.0),
    ("The acting was genuinely impressive in the second half.", "main_review", "Skip", 90.0, 5.0),
    ("यह फिल्म अच्छी है but tu nikamma hai", "reply_to_comment", "Perfection", 60.0, 40.0),
    ("t\u200bu chu\u200btiya hai", "reply_to_comment", "Timepass", 50.0, 20.0),
    ("\u0441hutiy\u0430 reviewer", "topic_feed", "Skip", 85.0, 10.0),
    ("mail me at someone@example.com or call 9876543210 about this film", "topic_feed", "Go For It", 70.0, 15.0),
    ("f  u.c_k this dirty religion debate, leave it", "reply_to_review", "Perfection", 40.0, 45.0),
    ("Skip gang ko movie samajh hi nahi aati, sab clown hain.", "reply_to_review", "Skip", 82.0, 9.0),
    ("see https://example.com/x from 10.0.0.1, the best film, I loved it soooooo much", "main_review", "Perfection", 95.0, 2.0),
    ("your religion debate is fine; all muslims are welcome, shut up and enjoy", "reply_to_comment", "Go For It", 65.0, 12.0),
]
