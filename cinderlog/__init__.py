"""Forensic log analytics as ordinary Spark DataFrame work.

``sources``    readers and sinks for CSV logs and raw tool output
``functions``  Column builders and the fixed values (catalog, rules, question cues)
``operators``  DataFrame -> DataFrame functions: family scan, profile, plan answers,
               question audit, votes, triage, excerpt
``streaming``  the same triage on a text stream
``plans``      the registered queries over the driver tables and their oracle SQL
"""
