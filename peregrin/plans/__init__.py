"""peregrin.plans"""
