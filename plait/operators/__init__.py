"""plait.operators"""
